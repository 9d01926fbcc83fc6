"""operators of quillmesh."""
