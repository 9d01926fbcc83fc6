"""plans of quillmesh."""
