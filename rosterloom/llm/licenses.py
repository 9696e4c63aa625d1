"""License scans with a positional index of rare tokens.

Templates are licence texts and notices, cut into words.  The document frequency of every
template word is counted over all documents.  Each template's ``ANCHORS`` words of highest IDF are its
postings: (template, position).  In a file, every place of an anchor word votes, with the word's
IDF, for the place at which its template would begin; votes for one beginning, give or
take ``SLACK`` words, are postings that agree in relative position.  A beginning with at
least ``AGREE`` of the template's anchor weight is a candidate, and it holds if one of the
template's mandatory phrases stands whole in the template's extent there.  The score is the
best share of a held template's words found in order in that extent.

Phrases are templates too, of which every word is an anchor and the whole text is mandatory, without
slack: their candidates are looked up by the rarest word and hold where all words follow
one another.

Words are lower-cased (A-Z) runs of letters, digits and bytes above 127.

The index knows the licences of ``TEMPLATES``, by a notice or a passage of the body; a caller passes others.

Defined cases: a null text is an empty one, without words, places and labels (score 0); rows that
repeat an id, or have none, have a result each; very long texts are scanned whole; an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.llm.common import by_value, table, whole
from rosterloom.llm.pretokens import text_parts
from rosterloom.llm.toxicity import word_table

by_value(__name__)

ANCHORS = 8
AGREE = 0.6
SLACK = 3

# Phrases with their labels.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Label, passage of the public licence text or its usual notice, mandatory phrases (one has to stand).
TEMPLATES = (
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge", "without limitation the rights to use copy modify merge"),
    ),
    (
        "apache-notice",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at",
        ("you may not use this file except in compliance with the license",),
    ),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    (
        "gpl-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        ("under the terms of the gnu general public license", "published by the free software foundation"),
    ),
    ("gpl-3", "licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        ("redistribution and use in source and binary forms",),
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify and or distribute this software",),
    ),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at",
        ("subject to the terms of the mozilla public license",),
    ),
    # passages of the licences' bodies
    (
        "apache-2.0",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, "
        "royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and "
        "distribute the Work and such Derivative Works in Source or Object form",
        ("publicly perform sublicense and distribute the work and such derivative works in source or object form",),
    ),
    (
        "gpl-2",
        "You may copy and distribute verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously "
        "and appropriately publish on each copy an appropriate copyright notice and disclaimer of warranty",
        ("copy and distribute verbatim copies of the program s source code as you receive it",),
    ),
    (
        "gpl-3",
        "You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and "
        "appropriately publish on each copy an appropriate copyright notice",
        ("convey verbatim copies of the program s source code as you receive it",),
    ),
    (
        "lgpl-2.1",
        "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free "
        "Software Foundation and other authors who decide to use it",
        ("applies to some specially designated software packages typically libraries",),
    ),
    (
        "lgpl-3",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, "
        "supplemented by the additional permissions listed below",
        ("of version 3 of the gnu general public license supplemented by the additional permissions",),
    ),
    (
        "agpl-3",
        "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users "
        "interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the "
        "Corresponding Source of your version",
        ("users interacting with it remotely through a computer network",),
    ),
    (
        "mpl-2.0",
        "under intellectual property rights (other than patent or trademark) Licensable by such Contributor to use, reproduce, make available, modify, "
        "display, perform, distribute, and otherwise exploit its Contributions, either on an unmodified basis, with Modifications, or as part of a "
        "Larger Work",
        ("licensable by such contributor to use reproduce make available modify display perform distribute",),
    ),
    (
        "bsd-2",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS",
        ("materials provided with the distribution this software is provided by the copyright holders",),  # no third clause between
    ),
    (
        "bsd-3",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission",
        ("be used to endorse or promote products derived from this software without specific prior written permission",),
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
        ("free and unencumbered software released into the public domain",),
    ),
    (
        "cc0-1.0",
        "The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the "
        "creator and subsequent owner(s) of an original work of authorship and/or a database",
        ("automatically confer exclusive copyright and related rights",),
    ),
    ("cc-by-4.0", "this Creative Commons Attribution 4.0 International Public License", ("creative commons attribution 4 0 international public license",)),
    ("cc-by-sa-4.0", "this Creative Commons Attribution-ShareAlike 4.0 International Public License", ("creative commons attribution sharealike 4 0 international public license",)),
    ("cc-by-nc-4.0", "this Creative Commons Attribution-NonCommercial 4.0 International Public License", ("creative commons attribution noncommercial 4 0 international public license",)),
    ("cc-by-nd-4.0", "this Creative Commons Attribution-NoDerivatives 4.0 International Public License", ("creative commons attribution noderivatives 4 0 international public license",)),
    ("cc-by-nc-sa-4.0", "this Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International Public License", ("creative commons attribution noncommercial sharealike 4 0 international public license",)),
    ("cc-by-nc-nd-4.0", "this Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International Public License", ("creative commons attribution noncommercial noderivatives 4 0 international public license",)),
    # short licence lines
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
)


def words_of(text: str, kinds: bytes = word_table()) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(kinds).split()


class Index:
    """Templates and phrases with their postings, ordered by the IDF of the corpus."""

    def __init__(self, templates, phrases, frequency: dict[bytes, int], documents: int):
        from math import log

        def idf(word):
            return log((documents + 1) / (frequency.get(word, 0) + 1)) + 1e-3

        self.phrases, self.templates, self.postings, self.phrase_at = [], [], {}, {}
        for text, label in phrases:
            words = words_of(text)
            rare = max(range(len(words)), key=lambda i: (idf(words[i]), -i))
            self.phrase_at.setdefault(words[rare], []).append((len(self.phrases), rare))
            self.phrases.append((words, label))
        for label, text, mandatory in templates:
            words = words_of(text)
            chosen = sorted(set(words), key=lambda w: (-idf(w), w))[:ANCHORS]
            weight = {w: idf(w) for w in chosen}
            t = len(self.templates)
            for at, w in enumerate(words):
                if w in weight:
                    self.postings.setdefault(w, []).append((t, at))
            self.templates.append((label, words, weight, [words_of(m) for m in mandatory]))
        self.wanted = set(self.postings) | set(self.phrase_at)

    def scan(self, words: list[bytes]):
        """(places of phrases as (start, phrase), held templates as {label: score})."""
        hits = [(i, w) for i, w in enumerate(words) if w in self.wanted]
        places, held = [], {}
        if not hits:
            return places, held
        votes: dict[tuple[int, int], set] = {}
        for i, w in hits:
            for p, at in self.phrase_at.get(w, ()):
                phrase = self.phrases[p][0]
                if i >= at and words[i - at : i - at + len(phrase)] == phrase:
                    places.append((i - at, p))
            for t, at in self.postings.get(w, ()):
                votes.setdefault((t, i - at), set()).add(w)
        seen: dict[int, int] = {}
        for t, start in sorted(votes):
            label, words_t, weight, mandatory = self.templates[t]
            agreed = set().union(*(votes.get((t, start + d), ()) for d in range(-SLACK, SLACK + 1)))
            if sum(weight[w] for w in agreed) < AGREE * sum(weight.values()):
                continue
            extent = words[max(0, start - SLACK) : max(0, start + len(words_t) + SLACK)]
            if any(stands(m, extent) for m in mandatory):
                held[label] = max(held.get(label, 0.0), in_order(words_t, extent) / len(words_t))
        return places, held


def stands(phrase: list[bytes], words: list[bytes]) -> bool:
    n = len(phrase)
    return any(words[i : i + n] == phrase for i, w in enumerate(words) if w == phrase[0])


def in_order(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def word_frequencies(docs: DataFrame, words: set[bytes], text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many documents each of the words occurs, and the number of documents.

    Every task adds up its own documents, so a task sends a row per word at most; the result
    is as large as the templates' vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        found, n = Counter(), 0
        for batch in batches:
            n += batch.num_rows
            for _, texts in text_parts(batch["text"]):
                for text in texts:
                    found.update(words.intersection(words_of(text)))
        yield pa.record_batch([pa.array([b"", *found], pa.binary()), pa.array([n, *found.values()], pa.int64())], names=["word", "n"])

    counted = docs.select(whole(text_col).alias("text")).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = {bytes(r["word"]): r["n"] for r in counted.collect()}
    return counts, counts.pop(b"", 0)


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    vocabulary = {w for _, text, _ in templates for w in words_of(text)} | {w for text, _ in phrases for w in words_of(text)}
    frequency, documents = word_frequencies(docs, vocabulary, text_col)
    index = Index(templates, phrases, frequency, documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(7)]
            for text in (t for _, texts in text_parts(batch["text"]) for t in texts):
                words = words_of(text)
                places, held = index.scan(words)
                starts = [s for s, _ in places]
                base = {index.phrases[p][1] for _, p in places}
                score = max([0.0, *held.values()]) if not places else 1.0
                row = (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(held))), score)
                for column, value in zip(out, row):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
            yield pa.record_batch([batch["id"], *[pa.array(c, k) for c, k in zip(out, kinds)]], names=["id", *names])

    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    scanned = rows.mapInArrow(run, f"id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")
    return scanned.withColumnRenamed("id", id_col)


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
