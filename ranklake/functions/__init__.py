"""Column expressions (built-in Spark functions only)."""

from ranklake.functions.bm25 import idf, quantized_length, tf_norm
from ranklake.functions.dates import warc_date_schema_a, warc_date_schema_b
from ranklake.functions.text import java_trim, text_snippet, tokens, word_count
from ranklake.functions.url import url_match_keys, url_schema_a, url_schema_b
from ranklake.functions.vectors import cosine_similarity, dot_product, squared_norm

__all__ = [
    "idf", "quantized_length", "tf_norm", "warc_date_schema_a", "warc_date_schema_b",
    "java_trim", "text_snippet", "tokens", "word_count", "url_match_keys",
    "url_schema_a", "url_schema_b", "cosine_similarity", "dot_product", "squared_norm",
]
