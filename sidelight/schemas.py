"""The engine's tables, declared rather than inferred."""

from __future__ import annotations

from pyspark.sql.types import StructType

LOCATION = "struct<country:string,city:string,province:string,name:string>"
#: Integer parts and not a DATE: a year without a month is a date here, and so is a month without a year.
DATE = "struct<year:int,month:int,day:int,source:string>"
QUERY_DATE = "struct<year:int,months:array<int>,day:int>"
ANSWER = "struct<text:string,cost:double,error:string>"

RECORD_DDL = f"path string, description string, keywords array<string>, people array<string>, location {LOCATION}, date {DATE}, source string, vector array<float>"
INDEX_DDL = RECORD_DDL + ", seq bigint"
RUN_LOG_DDL = "path string, status string, error string, context string, cost double"
FIX_LOG_DDL = "path string, status string, description string, keywords array<string>, cost double, error string"
ANOMALY_DDL = "path string, description_len int"
DUPLICATES_DDL = (
    "threshold double, total_photos bigint, compared_pairs bigint, "
    "clusters array<struct<size:int,avg_similarity:double,photos:array<struct<path:string,description:string>>>>"
)

RUN_STATUSES = ("created", "merged", "skipped_done", "skipped_has_subject", "error")
FIX_STATUSES = ("fixed", "still_glitched", "xmp_error", "error")


def schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
