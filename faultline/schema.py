"""Schemas of the stored tables (event fact table, issue table)."""

from __future__ import annotations

from pyspark.sql import types as T

KV = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))
FRAMES = T.ArrayType(T.StructType([
    T.StructField("abs_path", T.StringType()), T.StructField("colno", T.LongType()),
    T.StructField("filename", T.StringType()), T.StructField("function", T.StringType()),
    T.StructField("lineno", T.LongType()), T.StructField("in_app", T.ShortType()),
]))
STACKS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType())]))

# The event table.  Ints follow the store's unsigned widths (UInt8 -> short,
# UInt16 -> int, UInt32 / UInt64 -> long); "no user" is '' rather than NULL;
# tags and contexts are arrays of (key, value) because keys may repeat.
EVENT = T.StructType([
    T.StructField("pid", T.IntegerType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("deleted", T.ShortType()),
    T.StructField("retention_days", T.ShortType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("platform", T.ShortType()),
    T.StructField("env", T.StringType()),
    T.StructField("release", T.StringType()),
    T.StructField("ipv4", T.StringType()),
    T.StructField("ipv6", T.StringType()),
    T.StructField("user_ref", T.StringType()),
    T.StructField("user_email", T.StringType()),
    T.StructField("user_name", T.StringType()),
    T.StructField("user_username", T.StringType()),
    T.StructField("sdk_id", T.ShortType()),
    T.StructField("sdk_version", T.StringType()),
    T.StructField("tags", KV),
    T.StructField("contexts", KV),
    T.StructField("message", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("level", T.ShortType()),
    T.StructField("type", T.ShortType()),
    T.StructField("primary_hash", T.StringType()),
    T.StructField("exception_stacks", STACKS),
    T.StructField("exception_frames", FRAMES),
    T.StructField("gid", T.LongType()),
])

ISSUE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("project_id", T.IntegerType()),
    T.StructField("hash", T.StringType()),
    T.StructField("first_seen", T.TimestampNTZType()),
    T.StructField("last_seen", T.TimestampNTZType()),
    T.StructField("message", T.StringType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("view", T.StringType()),
    T.StructField("priority", T.IntegerType()),
    T.StructField("num_comments", T.LongType()),
])
