"""License notices by diagonal voting over word k-grams.

Words are A-Z in lower case, runs of ASCII letters, digits and all characters above U+007F. Every run of PHRASE words and of
NOTICE words of every text is hashed and joined to the places where a template has the same run (compared as words
too, so no hash stands for a word). A match votes for its diagonal, the text's place less the template's. Votes are added
up by text, template and diagonal; diagonals that are neighbours are merged to one span, as a word put in or left out
moves a copy to the next; a span is verified by how much of the template its runs cover and by its length. Short phrases
must be covered whole and are never merged. DataFrame functions only; the only broadcast tables are the templates'.

Defined cases: a null text has no words; repeated rows each have their own result, and ids may be null; a text without
words or without a find has no labels and score 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PHRASE = 2
NOTICE = 4
#: Neighbouring diagonals differ by at most so many words.
SLACK = 3
COVERAGE = 0.8
#: A span is at most so many times as long as its template.
STRETCH = 1.5

#: The phrases that count as base places.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Notices of well-known licenses, as words.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", "apache"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("you can redistribute it and or modify it under the terms of the gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("boost software license version 1 0", "bsl"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("all rights reserved no part of this publication may be reproduced", "reserved"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _grams(words: Column) -> Column:
    """Each word with those that follow it: w0, w1, ... (null past the end)."""
    return F.arrays_zip(*[(words if i == 0 else F.slice(words, i + 1, F.size(words))).alias(f"w{i}") for i in range(NOTICE)])


def _gram(k: int, of: str) -> Column:
    return F.concat_ws(" ", *[F.col(f"{of}.w{i}") for i in range(k)])


def _hash(k: int, of: str) -> Column:
    return F.when(F.col(f"{of}.w{k - 1}").isNotNull(), F.xxhash64(*[F.col(f"{of}.w{i}") for i in range(k)]))


def template_grams(spark: SparkSession, phrases: list[tuple[str, str]], notices: list[tuple[str, str]], k: int) -> DataFrame:
    """For each hash of a run of k words: the templates and places that have it."""
    every = [(*t, True, PHRASE) for t in phrases] + [(*t, False, NOTICE) for t in notices]
    one = F.array(*[F.struct(F.lit(n).alias("template"), F.lit(text).alias("text"), F.lit(label).alias("label"), F.lit(base).alias("base"), F.lit(size).alias("k")) for n, (text, label, base, size) in enumerate(every)])
    rows = spark.range(1).select(F.explode(one).alias("t")).select("t.*").where(F.col("k") == k).withColumn("words", F.split("text", " "))
    runs = rows.select("template", "label", "base", "k", F.size("words").alias("length"), F.posexplode(_grams(F.col("words"))).alias("at", "g"))
    runs = runs.withColumn("hash", _hash(k, "g")).where("hash is not null")
    return runs.groupBy("hash").agg(F.collect_list(F.struct("template", "label", "base", "k", "length", "at", _gram(k, "g").alias("gram"))).alias("places"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """id_col, n_words, spans (label, base, start, stop, coverage; words from 0, stop inclusive, in order) of every text."""
    spark = docs.sparkSession
    short, long = (F.broadcast(template_grams(spark, phrases, notices, k)) for k in (PHRASE, NOTICE))  # the templates only
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    runs = words.select("row", "id", F.size("words").alias("n_words"), F.posexplode_outer(_grams(F.col("words"))).alias("pos", "g"))
    runs = runs.select("row", "id", "n_words", F.coalesce("pos", F.lit(0)).alias("pos"), "g", _hash(PHRASE, "g").alias("short"), _hash(NOTICE, "g").alias("long"))
    matched = (
        runs.join(short.select(F.col("hash").alias("short"), F.col("places").alias("short_places")), "short", "left")
        .join(long.select(F.col("hash").alias("long"), F.col("places").alias("long_places")), "long", "left")
        .where("pos = 0 or short_places is not null or long_places is not null")
    )
    # The first row of a text stays with a null place, so that every text has a result.
    head = F.when(F.col("pos") == 0, F.array(F.lit(None))).otherwise(F.array())
    none = F.expr("cast(array() as array<struct<template:int,label:string,base:boolean,k:int,length:int,at:int,gram:string>>)")
    places = F.concat(head, F.coalesce("short_places", none), F.coalesce("long_places", none))
    votes = matched.select("row", "id", "n_words", "pos", "g", F.explode(places).alias("p"))
    votes = votes.where((F.col("p").isNull()) | (F.when(F.col("p.k") == PHRASE, _gram(PHRASE, "g")).otherwise(_gram(NOTICE, "g")) == F.col("p.gram")))
    diagonals = votes.groupBy("row", F.col("p.template").alias("template"), (F.col("pos") - F.col("p.at")).alias("diagonal")).agg(
        F.max("id").alias("id"),
        F.max("n_words").alias("n_words"),
        F.first("p.label").alias("label"),
        F.first("p.base").alias("base"),
        F.first("p.k").alias("k"),
        F.first("p.length").alias("length"),
        F.min("pos").alias("start"),
        F.max(F.col("pos") + F.col("p.k") - 1).alias("stop"),
        F.collect_set("p.at").alias("ats"),
    )
    covers = F.flatten(F.transform("ats", lambda a: F.sequence(a, a + F.col("k") - 1)))
    diagonals = diagonals.withColumn("covers", F.array_distinct(covers)).drop("ats", "k")
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(along) > SLACK)
    clusters = diagonals.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("cluster", F.sum("apart").over(along))
    spans = clusters.groupBy("row", "template", "cluster").agg(
        F.max("id").alias("id"),
        F.max("n_words").alias("n_words"),
        F.first("label").alias("label"),
        F.first("base").alias("base"),
        F.first("length").alias("length"),
        F.min("start").alias("start"),
        F.max("stop").alias("stop"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("covers")))) / F.first("length")).alias("coverage"),
    )
    sound = F.col("template").isNotNull() & F.when(F.col("base"), F.col("coverage") == 1).otherwise((F.col("coverage") >= COVERAGE) & (F.col("stop") - F.col("start") < STRETCH * F.col("length")))
    span = F.when(sound, F.struct("label", "base", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "coverage"))
    out = spans.groupBy("row").agg(F.max("id").alias("id"), F.max("n_words").cast("long").alias("n_words"), F.collect_list(span).alias("spans"))
    by_place = F.array_sort("spans", lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0))
    return out.select(F.col("id").alias(id_col), "n_words", by_place.alias("spans"))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """n_base, first_word, last_word, base_labels, labels and score from the spans."""
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return scanned.select(
        id_col,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )
