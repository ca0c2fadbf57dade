"""License scans: phrases, and an exact set-similarity join of text blocks with license notices."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from doclens.llm.shared import documents, written

#: Share of a notice's distinct words that a block must hold.
CONTAINMENT = 0.9
#: A line of more words than BLOCK is cut into blocks that start every STEP words.
BLOCK, STEP = 64, 32
#: Share of extra words between those of a notice that a window is sure to hold (comment marks of words, line numbers).
SLACK = 0.25
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Notices by label. One whose words are all in another's as well needs that other here, for the larger match to rule it out.
NOTICES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("lgpl", "licensed under the GNU Lesser General Public License, version 3"),
    ("lgpl", "licensed under the GNU Lesser General Public License, version 2.1"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License, version 3"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0"),
    ("cc0-1.0", "released into the public domain under CC0 1.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def tokens(text: str) -> list[str]:
    return [w.decode() for w in WORD.findall(text.encode().lower())]


def notice_table(notices: list[tuple[str, str]]) -> list[tuple[int, str, list[str]]]:
    return [(k, label, sorted(set(tokens(text)))) for k, (label, text) in enumerate(notices)]


def window_step(n_words: int) -> int:
    """Step of the windows for a notice of so many words; a window has two steps.

    Whatever spans one step of words or fewer, wherever it begins, lies whole in some window.
    Powers of two, so notices of like length share their windows.
    """
    return 1 << max(3, math.ceil(n_words * (1 + SLACK)) - 1).bit_length()


def document_frequencies(docs: DataFrame, text_col: str, vocabulary: set[str]) -> dict[str, int]:
    """Documents that hold each word of the notices, counted over all documents.

    The vocabulary is that of the notices, so the counts that reach the driver are as many.
    """
    wanted = {w.encode() for w in vocabulary}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                if text:
                    total.update(wanted.intersection(WORD.findall(text.lower())))
        yield pa.RecordBatch.from_pydict(
            {"word": [w.decode() for w in total], "n": pa.array(list(total.values()), pa.int64())},
            schema=pa.schema([("word", pa.string()), ("n", pa.int64())]),
        )

    found = docs.select(F.col(text_col)).mapInArrow(count, "word string, n bigint")
    counted = {r.word: r.n for r in found.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: counted.get(w, 0) for w in vocabulary}


#: Phrases of the base labels.
PHRASES = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}


def phrase_scores(notices: list[tuple[str, str]]) -> dict[str, float]:
    """What a phrase alone is worth: the share it has of a notice's distinct words, at most."""
    sets = [set(words) for _, _, words in notice_table(notices)]
    return {label: max([len(words) / len(s) for s in sets if s.issuperset(words)], default=0.0) for label, words in PHRASES.items()}


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start, label) of every phrase of PHRASES."""
    places = []
    for i, w in enumerate(words):
        if w == b"license" and i:
            if words[i - 1] == b"mit":
                places.append((i - 1, "mit"))
            elif words[i - 1] == b"apache":
                places.append((i - 1, "apache"))
            elif i > 1 and words[i - 1] == b"public" and words[i - 2] == b"general":
                places.append((i - 2, "gpl"))
    return sorted(places)


SCANNED = (
    "row bigint, doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base array<string>, "
    "blocks array<struct<block: int, step: int, first: bigint, words: array<string>>>"
)


def scanner(prefix_words: set[str], windows: dict[int, set[str]]):
    """Per row: a key of its own, word count, base phrases, and the blocks that hold a prefix word of some notice.

    windows: steps, and the prefix words of the notices that are looked for in windows of two
    steps over the words of the whole document, whatever its lines. step is 0 for lines.
    """
    rare = {w.encode() for w in prefix_words}
    by_step = {step: {w.encode() for w in own} for step, own in windows.items()}

    def held(part: set[bytes]) -> list[str]:
        return sorted(w.decode("utf-8", "replace") for w in part)

    def blocks_of(low: bytes, every: list[bytes]) -> list[dict]:
        found: list[dict] = []
        first = 0
        for line in low.split(b"\n"):
            words = WORD.findall(line)
            if not rare.isdisjoint(words):
                for start in range(0, max(1, len(words) - STEP), STEP) if len(words) > BLOCK else (0,):
                    part = set(words[start : start + BLOCK])
                    if not rare.isdisjoint(part):
                        found.append({"block": len(found), "step": 0, "first": first + start, "words": held(part)})
            first += len(words)
        for step, own in by_step.items():
            # The last window may be short; one that begins in it would hold nothing more.
            last = max(0, (len(every) - 1) // step - 1)
            places = {min(k, last) for i, w in enumerate(every) if w in own for k in (max(0, i // step - 1), i // step)}
            for start in (k * step for k in sorted(places)):
                found.append({"block": len(found), "step": step, "first": start, "words": held(set(every[start : start + 2 * step]))})
        return found

    schema = pa.schema(
        [("row", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")], ("base", pa.list_(pa.string())),
         ("blocks", pa.list_(pa.struct([("block", pa.int32()), ("step", pa.int32()), ("first", pa.int64()), ("words", pa.list_(pa.string()))])))]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for start in range(0, len(batch), 1000):
                part = batch.slice(start, 1000)
                out = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    low = (text or b"").lower()
                    words = WORD.findall(low)
                    places = base_places(words) if b"license" in low else []
                    row += 1
                    out.append({
                        "row": row, "doc_id": doc_id, "n_words": len(words), "n_base": len(places),
                        "first_word": places[0][0] if places else None, "last_word": places[-1][0] if places else None,
                        "base": sorted({label for _, label in places}), "blocks": [] if rare.isdisjoint(words) else blocks_of(low, words),
                    })
                yield pa.RecordBatch.from_pylist(out, schema)

    return scan


def license_scan(
    docs: DataFrame,
    notices: list[tuple[str, str]] = NOTICES,
    threshold: float = CONTAINMENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    across_lines: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(scanned, matches): base phrases by row of docs, and every block that holds a notice.

    A block is a line, or BLOCK words of a longer one. Notices of more than BLOCK - STEP words
    are looked for in windows over the words of the document as well, and so is every notice
    with across_lines: it is then found however its lines are broken. A window has twice the
    notice's words at least and they overlap by half, so a notice of any length lies whole in
    one, with SLACK extra words between its own. A block matches a notice when it holds at
    least threshold of the notice's distinct words. Words are ordered by their document
    frequency over docs, rarest first; a match must share one of a notice's first
    size - needed + 1 words (prefix), have needed words or more (length), and enough words
    from the first shared one on, in both (position); survivors are counted exactly.
    matches has (row, doc_id, block, first, notice, label, containment, best): row is the key
    of the row in scanned. best is false for what the block does not say: a notice all of whose
    words are in a larger one that the block matches too, and a larger one without the words
    that tell it from the smaller. Null and empty texts have no words; repeated rows, also of
    one id or none, are scanned each; other columns are left out.
    """
    spark = docs.sparkSession
    table = notice_table(notices)
    frequency = document_frequencies(docs, text_col, {w for _, _, words in table for w in words})
    ordered = [(k, label, sorted(words, key=lambda w: (frequency[w], w))) for k, label, words in table]
    prefix_rows, notice_rows, windows = [], [], {}
    for k, label, words in ordered:
        n_words = len(tokens(notices[k][1]))
        step = window_step(n_words) if across_lines or n_words > BLOCK - STEP else None
        needed = math.ceil(threshold * len(words) - 1e-9)
        telling = sorted({w for _, _, other in table if set(other) < set(words) for w in set(words) - set(other)})
        notice_rows.append((k, label, words, telling, len(words), needed))
        prefix = words[: len(words) - needed + 1]
        prefix_rows += [(w, k, p, step) for p, w in enumerate(prefix)]
        if step:
            windows.setdefault(step, set()).update(prefix)
    scanned = written(
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
            scanner({w for w, _, _, _ in prefix_rows}, windows), SCANNED
        ),
        "license-blocks",
    )
    # One row for each notice and prefix word: a fixed, small table.
    prefixes = spark.createDataFrame(prefix_rows, "word string, notice int, position int, notice_step int")
    whole = spark.createDataFrame(notice_rows, "notice int, label string, notice_words array<string>, telling array<string>, size int, needed int")
    rank = {w: i for i, w in enumerate(sorted(frequency, key=lambda w: (frequency[w], w)))}
    ranks = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    blocks = scanned.select("row", "doc_id", F.explode("blocks").alias("b")).select("row", "doc_id", "b.block", "b.step", "b.first", "b.words")
    # Words outside the notices cannot match; they count for the length filter alone.
    known = F.sort_array(F.transform(F.filter("words", lambda w: F.map_contains_key(ranks, w)), lambda w: F.struct(ranks[w].alias("rank"), w.alias("word"))))
    known_blocks = blocks.select("row", "doc_id", "block", "step", "first", F.size("words").alias("n"), known.alias("known"))
    probes = known_blocks.select(
        "row", "doc_id", "block", "step", "first", "n", F.transform("known", lambda x: x["word"]).alias("held"), F.posexplode("known").alias("at", "x")
    ).select("row", "doc_id", "block", "step", "first", "n", "held", "at", F.col("x.word").alias("word"))
    candidates = (
        probes.join(F.broadcast(prefixes), "word")
        .join(F.broadcast(whole), "notice")
        .where("n >= needed")
        .where("1 + least(size - position - 1, size(held) - at - 1) >= needed")
    )
    overlap = F.size(F.array_intersect("held", "notice_words"))
    matches = (
        candidates.withColumn("overlap", overlap)
        .where("overlap >= needed")
        .select(
            "row", "doc_id", "block", "first", "notice", "label", (F.col("overlap") / F.col("size")).alias("containment"),
            (F.size(F.array_except("telling", "held")) == 0).alias("told"),
            # Windows of other notices' steps only show what else a block holds.
            F.expr("step = 0 or step <=> notice_step").alias("own"),
        )
        .distinct()
    )
    # Which notices each lies in: at most as many numbers as notices, whatever the data.
    larger = {k: [j for j, _, other in table if set(words) < set(other)] for k, _, words in table}
    inside = F.create_map(*[x for k, own in larger.items() for x in (F.lit(k), F.array(*[F.lit(j) for j in own]).cast("array<int>"))])
    together = F.collect_set(F.when(F.col("told"), F.col("notice"))).over(W.partitionBy("row", "block"))
    best = F.col("told") & ~F.arrays_overlap(inside[F.col("notice")], together)
    return scanned, matches.withColumn("best", best).where("own").drop("told", "own")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the best matches; score: the largest containment of these, or what the base phrases are worth."""
    scanned, matches = license_scan(documents(spark, sf_dir), across_lines=True)
    found = written(
        matches.where("best").groupBy(F.col("row").alias("match_row")).agg(
            F.collect_set("label").alias("more"), F.max("containment").alias("containment")
        ),
        "license-labels",
    )
    joined = scanned.join(found, scanned["row"] == found["match_row"], "left")
    every = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    worth = F.create_map(*[F.lit(x) for pair in phrase_scores(NOTICES).items() for x in pair])
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.coalesce(F.greatest("containment", F.array_max(F.transform("base", lambda label: worth[label]))), F.lit(0.0)).alias("score"),
    )
