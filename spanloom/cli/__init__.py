"""Command-line tools: ``python -m spanloom.cli TOOL ARGUMENTS``, thin over the library."""
