"""Column -> Column expressions. All are built-in Spark expressions (codegen, JVM side)."""

from tidemark.functions.checksums import (  # noqa: F401
    checksum_changed, meta_checksum, meta_file_id, normalize_checksum, skip_from_store, strip_ws,
)
from tidemark.functions.mime import is_video_like  # noqa: F401
from tidemark.functions.paths import (  # noqa: F401
    bucket_key, expected_key, key_basename, object_key, sanitize_file_name,
)
from tidemark.functions.sizes import chunk_ranges, effective_size, sample_offsets  # noqa: F401
