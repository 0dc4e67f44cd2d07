"""Runnable jobs: each has a command line, a config file of the same name, and a function that takes a session."""
