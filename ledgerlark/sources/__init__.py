"""Reading, checking and writing tables and fitted artefacts."""
