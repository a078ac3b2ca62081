"""The subpackage's registered queries and, where SQL can express one, the SQL that gives the same rows."""

from __future__ import annotations

from .langid import op7_string_kernel_langid
from .licenses import op5_license_digests
from .licenses import oracle_sql as op5_sql
from .media import op10_chunked_media
from .minhash import op9_minhash_fingerprints
from .mixing import op2_entropy_mixing
from .packing import op3_best_fit_packing
from .pii import op8_boosted_pii
from .quality import op1_bradley_terry_quality
from .sharding import op6_jump_sharding
from .simhash import op4_simhash_near_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_bradley_terry_quality,
        op2_entropy_mixing,
        op3_best_fit_packing,
        op4_simhash_near_dedup,
        op5_license_digests,
        op6_jump_sharding,
        op7_string_kernel_langid,
        op8_boosted_pii,
        op9_minhash_fingerprints,
        op10_chunked_media,
    )
}

ORACLE_SQL: dict[str, str] = {"op5_license_digests": op5_sql()}
