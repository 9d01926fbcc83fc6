"""functions of quillmesh."""
