"""The queries of this subpackage, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import warc
from .jaccard import op3_jaccard
from .language import op8_language
from .media import op4_media
from .mixing import op6_mixing
from .neighbours import op9_neighbours
from .packing import op10_packing
from .quality import op2_quality
from .secrets import op1_secrets
from .urls import op5_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_quality": op2_quality,
    "op3_jaccard": op3_jaccard,
    "op4_media": op4_media,
    "op5_urls": op5_urls,
    "op6_mixing": op6_mixing,
    "op7_warc": warc.op7_warc,
    "op8_language": op8_language,
    "op9_neighbours": op9_neighbours,
    "op10_packing": op10_packing,
}

SQL: dict[str, str] = {"op7_warc": warc.SQL}
