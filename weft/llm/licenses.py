"""License notices in texts: exact phrases, and fuzzy short notices.

A notice may be met with a bounded number of edits. It is split into one piece more than that; by the pigeonhole principle a
match has one of them whole, so exact finds of the pieces are the seeds, in the text with every run of other bytes than words'
squeezed to one space. Around each seed the regex library's bounded-error matching verifies the edits and gives the span.

Defined results: a null or empty text has no words, places or labels and score 0; repeated rows are scanned each for itself.
"""

from __future__ import annotations

import re
from bisect import bisect

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import lower_ascii, row_chunks, text_bytes

#: fixed values: phrase and label
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: notice, label, edits
NOTICES = [
    ("general public license", "gpl", 2),
    ("all rights reserved", "reserved", 2),
    ("creative commons attribution", "creative-commons", 2),
    ("licensed under the apache license", "apache", 3),
    ("permission is hereby granted free of charge", "mit", 4),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("mozilla public license", "mpl", 2),
]
WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
IN, OUT = rb"[0-9a-z\x80-\xff]", rb"[^0-9a-z\x80-\xff]"


class Notice:
    def __init__(self, text: str, label: str, edits: int):
        self.text, self.label, self.edits, self.size = text.encode(), label, edits, len(text)
        cuts = [k * self.size // (edits + 1) for k in range(edits + 2)]
        self.seeds = [(self.text[a:b], a) for a, b in zip(cuts, cuts[1:])]
        self.fuzzy = regex.compile(rb"(?b)(?:" + regex.escape(self.text) + rb"){e<=%d}" % edits)

    def find(self, text: bytes) -> list[tuple[int, int, int]]:
        """Spans of matches in a squeezed text, and their edits; one of each set of overlapping matches, the best."""
        found: dict[tuple[int, int], int] = {}
        at = text.find(self.text)
        while at >= 0:  # whole notices need no verifying
            found[at, at + self.size] = 0
            at = text.find(self.text, at + 1)
        exact = list(found)  # from left to right; all have one length, so the last that begins before a place covers most after it
        for seed, offset in self.seeds:
            at = text.find(seed)
            while at >= 0:
                k = bisect(exact, (at, len(text))) - 1
                if k < 0 or at + len(seed) > exact[k][1]:
                    low = max(0, at - offset - self.edits)
                    m = self.fuzzy.search(text[low : at - offset + self.size + self.edits])
                    if m:
                        a, b = m.span()
                        found.setdefault((low + a, low + b), sum(m.fuzzy_counts))
                at = text.find(seed, at + 1)
        out: list[tuple[int, int, int]] = []
        for (a, b), e in sorted(found.items(), key=lambda x: (x[1], x[0])):
            while a < b and text[a] == 32:
                a += 1
            while b > a and text[b - 1] == 32:
                b -= 1
            k = bisect(out, (a, b, e))  # spans taken so far, which don't overlap, in order: the neighbours decide
            if a < b and (k == 0 or out[k - 1][1] <= a) and (k == len(out) or b <= out[k][0]):
                out.insert(k, (a, b, e))
        return out


def word_pattern(phrase: str) -> re.Pattern:
    return re.compile(rb"(?<!" + IN + rb")" + (OUT + rb"+").join(map(re.escape, phrase.encode().split())) + rb"(?!" + IN + rb")")


SCHEMA = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("label", T.StringType()), T.StructField("edits", T.IntegerType())]))),
]


def scan(docs: DataFrame, base: list = BASE, notices: list = NOTICES) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score and spans (byte spans of fuzzy matches in the
    UTF-8 text); columns of these names are replaced. score: 1 for a base phrase or an exact notice, less by the share of edits."""
    docs = docs.drop(*[f.name for f in SCHEMA])

    def run(batches):
        phrases = [(word_pattern(p), p.encode().split(), label) for p, label in base]
        fuzzy = [Notice(*n) for n in notices]
        seeds = sorted({s for n in fuzzy for s, _ in n.seeds})
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            rows = []
            for i, j in row_chunks(offs):
                low = lower_ascii(data[offs[i] : offs[j]])
                mask = WORD[low]
                own = offs[i : j + 1] - offs[i]
                begins = mask & ~np.concatenate([[False], mask[:-1]])
                inner = own[:-1][np.diff(own) > 0]
                begins[inner] = mask[inner]
                starts = np.flatnonzero(begins)
                first = np.searchsorted(starts, own)
                raw = low.tobytes()
                keep = mask | np.concatenate([[True], mask[:-1]])
                keep[inner] = True
                squeezed = np.where(mask, low, 32)[keep].tobytes()
                at = np.concatenate([[0], np.cumsum(keep)])[own].tolist()
                for k in range(j - i):
                    text = raw[own[k] : own[k + 1]]
                    places, labels, all_labels, best = [], set(), set(), 0.0
                    for pattern, words, label in phrases:
                        if all(w in text for w in words):
                            hits = [m.start() for m in pattern.finditer(text)]
                            if hits:
                                places += hits
                                labels.add(label)
                    spans = []
                    flat = squeezed[at[k] : at[k + 1]]
                    present = {s for s in seeds if s in flat}
                    if present:
                        back = np.flatnonzero(keep[own[k] : own[k + 1]])
                        for n in fuzzy:
                            if any(s in present for s, _ in n.seeds):
                                for a, b, e in n.find(flat):
                                    spans.append({"start": int(back[a]), "end": int(back[b - 1]) + 1, "label": n.label, "edits": e})
                                    all_labels.add(n.label)
                                    best = max(best, 1 - e / n.size)
                    index = np.searchsorted(starts, np.array(places, np.int64) + own[k]) - first[k]
                    rows.append((int(first[k + 1] - first[k]), len(places), int(index.min()) if places else None, int(index.max()) if places else None, ",".join(sorted(labels)), ",".join(sorted(labels | all_labels)), 1.0 if places else best, spans))
            columns = list(zip(*rows)) if rows else [[]] * len(SCHEMA)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*batch.schema.names, *(f.name for f in SCHEMA)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *SCHEMA]))
