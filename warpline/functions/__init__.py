"""Part of the warpline engine."""
