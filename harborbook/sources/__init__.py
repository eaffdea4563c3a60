from harborbook.sources.book import TABLES, Book, conform, from_catalog, from_frames, from_parquet, schema_of
from harborbook.sources.sinks import write_mart

__all__ = ["TABLES", "Book", "conform", "from_catalog", "from_frames", "from_parquet", "schema_of", "write_mart"]
