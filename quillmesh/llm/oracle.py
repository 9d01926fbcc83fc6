"""SQL of the queries of this subpackage that SQL can express."""

_USABLE = """v AS (SELECT DISTINCT ON (vec_id) vec_id, vector.values AS x, coalesce(embedding_version, '') || '|' || vector.dimensions AS space FROM vector_records
 WHERE vec_id IS NOT NULL AND len(vector.values) = vector.dimensions AND len(list_filter(vector.values, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector.values, lambda x: x <> 0)) > 0 ORDER BY vec_id, ingested_at)"""
_STOPS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}。！？；，、：.!?;,:।]"

ORACLE: dict[str, str] = {
    "p1_found": f"WITH {_USABLE} SELECT a.vec_id AS vec_a, b.vec_id AS vec_b FROM v a JOIN v b USING (space) WHERE a.vec_id < b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95",
    "p1_exact": f"""WITH {_USABLE}, n AS (SELECT a.vec_id AS vec_a, b.vec_id AS vec_b, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.x, b.x) DESC, b.vec_id) AS n
        FROM v a JOIN v b USING (space) WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) SELECT vec_a, vec_b FROM n WHERE n <= 10""",
    "p6_ranges": """WITH t AS (SELECT DISTINCT 'block_text' AS field_name, block_id AS record_id, text FROM normalized_blocks UNION SELECT 'chunk_content', chunk_id, content FROM knowledge_chunks UNION SELECT 'chunk_index_text', chunk_id, index_text FROM knowledge_chunks)
        SELECT field_name, record_id, length(text) AS chars, 0 AS gaps, 0 AS too_long, 0 AS too_much_overlap FROM t JOIN size_limits USING (field_name) WHERE length(text) > max_chars""",
    "p6_found": f"""WITH t AS (SELECT DISTINCT 'block_text' AS field_name, block_id AS record_id, text FROM normalized_blocks UNION SELECT 'chunk_content', chunk_id, content FROM knowledge_chunks UNION SELECT 'chunk_index_text', chunk_id, index_text FROM knowledge_chunks)
        SELECT field_name, record_id, CASE WHEN list_max(list_transform(regexp_split_to_array(text, '{_STOPS}'), lambda x: length(x))) > max_chars THEN 'forced' ELSE 'natural' END AS cut_kind FROM t JOIN size_limits USING (field_name) WHERE length(text) > max_chars""",
}
