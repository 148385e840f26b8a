"""Explicit schemas for every source (no schema inference)."""

from pyspark.sql import types as T

RAW_POSTS = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("symbol", T.StringType()),
    T.StructField("company", T.StringType()),
])

SCORED_POSTS = T.StructType(RAW_POSTS.fields + [
    T.StructField("cleaned_text", T.StringType()),
    T.StructField("text_length", T.LongType()),
    T.StructField("compound", T.DoubleType()),
])

PRICES = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("adj_close", T.DoubleType()),
    T.StructField("volume", T.LongType()),
    T.StructField("symbol", T.StringType()),
])

LEXICON = T.StructType([
    T.StructField("token", T.StringType(), False),
    T.StructField("valence", T.DoubleType(), False),
])

LEMMAS = T.StructType([
    T.StructField("form", T.StringType(), False),
    T.StructField("lemma", T.StringType(), False),
])

SCALER = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("feature", T.StringType()),
    T.StructField("data_min", T.DoubleType()),
    T.StructField("data_max", T.DoubleType()),
    T.StructField("lo", T.DoubleType()),
    T.StructField("hi", T.DoubleType()),
])
