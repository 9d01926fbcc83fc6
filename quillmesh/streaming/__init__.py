"""streaming of quillmesh."""
