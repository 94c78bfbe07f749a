"""Incremental work on growing inputs."""
