"""Metadata values and minutes that files of two groups or more share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import casefold_key, minute_key

# Fields with label, level and reason; values too common to mean anything.
EXACT = [("author", "作者", "高", "不同分组文档的作者元数据相同"), ("company", "公司", "高", "不同分组文档的公司元数据相同"), ("last_modified_by", "最后修改者", "中", "不同分组文档的最后修改者元数据相同")]
TIMES = [("created", "创建时间", "中", "不同分组文档的内部创建时间处于同一分钟"), ("modified", "修改时间", "中", "不同分组文档的内部修改时间处于同一分钟")]
COMMON = ["admin", "administrator", "default", "kingsoft office", "microsoft corporation", "microsoft office user", "n/a", "none", "python-docx", "unknown", "user", "wps office"]
COMMON_MINUTES = ["2013-12-23 23:15"]
SHOWN = 200
_SPACE = "^[\\s\\u00a0\\u3000]+|[\\s\\u00a0\\u3000]+$"


def metadata_values(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, file columns, field, label, level, reason, raw, value): the fields of every file, unpivoted once.

    Values are stripped; empty ones and the common ones are left out. A time's value is its minute.
    """
    cols = [*keys, "doc_id", "group_name", "file_path", "file_name"]
    spec = F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(("field", "label", "level", "reason"), row)), F.lit(kind).alias("kind")) for kind, table in (("value", EXACT), ("time", TIMES)) for row in table))
    rows = files.select(*cols, "metadata", F.explode(spec).alias("s")).select(*cols, "s.*", F.regexp_replace(F.coalesce(F.col("metadata")[F.col("s.field")], F.lit("")), _SPACE, "").alias("raw")).filter("raw <> ''")
    exact = rows.filter("kind = 'value'").withColumn("value", casefold_key("raw")).filter((F.col("value") != "") & ~F.col("value").isin(COMMON))
    times = rows.filter("kind = 'time'").withColumn("value", minute_key(F.col("raw"))).filter((F.col("value") != "") & ~F.col("value").isin(COMMON_MINUTES))
    return exact.unionByName(times)


def metadata_alerts(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, label, level, value, groups, hits, reason): values that two group names or more share."""
    values = metadata_values(files, keys)
    by = [*keys, "field", "value"]
    several = values.groupBy(*by).agg(F.min("group_name").alias("_lo"), F.max("group_name").alias("_hi")).filter("_lo <> _hi").drop("_lo", "_hi")
    held = values.join(several, by, "left_semi")
    hit = F.struct("doc_id", "group_name", "file_path", "file_name", F.left("raw", F.lit(SHOWN)).alias("value"))
    alerts = held.groupBy(*by).agg(F.first("label").alias("label"), F.first("level").alias("level"), F.first("reason").alias("reason"), F.first("kind").alias("kind"), F.array_sort(F.collect_set("group_name")).alias("groups"), F.array_sort(F.collect_list(hit)).alias("hits"))
    shown = F.when(F.col("kind") == "time", F.concat("value", F.lit("（同一分钟）"))).otherwise(F.col("hits")[0]["value"])
    return alerts.select(*keys, "field", "label", "level", F.col("value").alias("key"), shown.alias("value"), "groups", "hits", "reason")
