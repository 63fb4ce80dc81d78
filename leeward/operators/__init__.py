"""DataFrame -> DataFrame operators, shared by batch and streaming."""
