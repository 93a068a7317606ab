"""Flows and jobs: ordered steps over frames, user functions, sinks."""
