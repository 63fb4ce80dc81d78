"""Licence scan over whole texts by a positional index of rare licence words, in DataFrame functions only.

A template is the wording of a licence notice, as words with positions, and the key phrases that must stand in a text before
the notice counts. Which words are rare is asked of the corpus: one pass counts the documents of every template word, and the
index keeps of each template the words of highest inverse document frequency, as postings (template, position). The second pass looks
up a text's index words. A word at place i with posting (t, o) proposes that template t starts at i - o; the postings of t are
intersected by relative position (each index word is looked for at its own distance, give or take ``slack`` words), and
where enough of them stand, the key phrases decide. A notice's share is the part of the template's inverse document frequency whose
words stand in their places.

Everything happens within a row, so nothing but the counts of the template words (bounded by the templates) is shuffled or collected, and
a text costs its words plus, for each index word in it, its few postings.

Base phrases are counted at every place. Null text: empty, no words. Rows with null ids, copies and repeated rows are rows of their own. No
rows give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leeward.llm.shared import ident

#: What lies between words of lower-cased text.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KELVIN = "\u212A"         # the only character whose lower case is a word of A-Z
# Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Label, wording of the notice, mandatory key phrases.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     ("hereby granted free of charge", "obtaining a copy")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "2 0")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-2.0", "under the terms of the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license", ("affero general public license",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("epl", "made available under the terms of the eclipse public license", ("eclipse public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ("source and binary forms", "with or without modification")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ("copy modify", "this software for any purpose")),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    ("cc0", "to the public domain under the creative commons cc0 1 0 universal", ("cc0 1 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license", ("creative commons attribution", "international license")),
)
RARE = 4                # index words of a template
SLACK = 1               # words by which an index word or phrase may stand off its place


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[int, tuple[str, ...]], ...]            # (position, words)


def templates(source=TEMPLATES) -> list[Template]:
    made = []
    for label, text, keys in source:
        words = tuple(text.split())
        phrases = []
        for key in keys:
            phrase = tuple(key.split())
            at = next((i for i in range(len(words)) if words[i:i + len(phrase)] == phrase), None)
            if at is None:
                raise ValueError(f"key phrase {key!r} is not in the template of {label}")
            phrases.append((at, phrase))
        made.append(Template(label, words, tuple(phrases)))
    return made


def words_of(text: Column) -> Column:
    """Words, none for null. Other letters than A-Z are lower-cased too, which no comparison with words of a to z can tell."""
    lower = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit("\uE000")))
    return F.filter(F.split(lower, BETWEEN), lambda w: w != "")       # empty ones at the ends only


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` and the lambdas in it look at it."""
    return F.transform(F.array(value), use)[0]


def idf(docs: DataFrame, source: list[Template], text_column: str = "text") -> dict[str, float]:
    """Inverse document frequency of every template word over all rows of ``docs``."""
    vocabulary = sorted({w for t in source for w in t.words})
    known = F.array_distinct(F.filter(words_of(ident(docs, text_column)), lambda w: w.isin(vocabulary)))
    # The empty string, which is no word, counts the rows. An outer explode keeps Spark from working the array out twice for a filter.
    seen = docs.select(F.explode_outer(F.concat(F.array(F.lit("")), known)).alias("w")).groupBy("w").count()
    counts = {r["w"]: r["count"] for r in seen.collect()}       # at most one row per template word
    n = counts.get("", 0)
    return {w: math.log((n + 1) / (counts.get(w, 0) + 1)) + 1e-9 for w in vocabulary}


def rare_words(template: Template, weight: dict[str, float], rare: int = RARE) -> list[tuple[int, str]]:
    """(position, word) of the words that index a template, rarest first."""
    order = sorted(range(len(template.words)), key=lambda i: (-weight[template.words[i]], template.words[i], i))
    return [(i, template.words[i]) for i in order[:rare]]


def _phrase(words: Column, at: Column, phrase: tuple[str, ...]) -> Column:
    """Whether ``phrase`` stands at place ``at``. Word by word: a slice would copy the whole text's words."""
    same = F.lit(True)
    for k, word in enumerate(phrase):
        same = same & (F.get(words, at + k) == word)
    return F.coalesce(same, F.lit(False))


def _stands(words: Column, start: Column, place: int, phrase: tuple[str, ...], slack: int) -> Column:
    """The same at ``start + place``, give or take ``slack`` words."""
    near = F.array(*[F.lit(place + d) for d in sorted(range(-slack, slack + 1), key=abs)])
    return F.exists(near, lambda d: _phrase(words, start + d, phrase))


def _notice(words: Column, start: Column, template: Template, index: list[tuple[int, str]], weight: dict[str, float], slack: int) -> Column:
    """(label, start, end, share) where the template stands at ``start``, else null."""
    near = [F.greatest(*[(F.get(words, start + (o + d)) == w).cast("int") for d in range(-slack, slack + 1)]) if slack
            else (F.get(words, start + o) == w).cast("int") for o, w in index]
    met = sum((F.coalesce(n, F.lit(0)) for n in near), F.lit(0))
    need = max(1, -(-2 * len(index) // 3))
    stands = met >= need
    for place, phrase in template.phrases:
        stands = stands & _stands(words, start, place, phrase, slack)
    total = sum(weight[w] for w in template.words)
    share = sum((F.when(F.get(words, start + i) == w, weight[w]).otherwise(0.0) for i, w in enumerate(template.words)), F.lit(0.0))
    return F.when(stands, F.struct(F.lit(template.label).alias("label"), start.alias("start"),
                                   (start + len(template.words)).alias("end"), F.least(share / total, F.lit(1.0)).alias("share")))


def scan(docs: DataFrame, *, source: list[Template] | None = None, base=BASE, id_column: str = "doc_id", text_column: str = "text",
         rare: int = RARE, slack: int = SLACK) -> DataFrame:
    """Per row: the id, ``n_words``, ``base`` (label and start of every base phrase, by start) and ``notices`` (label, start, end, share)."""
    source = templates() if source is None else source
    weight = idf(docs, source, text_column)
    index = [rare_words(t, weight, rare) for t in source]
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, entries in enumerate(index):
        for o, w in entries:
            postings.setdefault(w, []).append((t, o))
    table = F.create_map(*[x for w, found in sorted(postings.items()) for x in (
        F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(o).alias("o")) for t, o in found]))])
    firsts = {p.split()[0] for p, _ in base}
    looked = sorted(set(postings) | firsts)

    def told(words: Column) -> Column:
        at = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(looked), i)))
        return _let(at, lambda at: F.struct(F.size(words).cast("long").alias("n_words"), bases(words, at).alias("base"),
                                            notices(words, at).alias("notices")))

    def bases(words: Column, at: Column) -> Column:
        label = lambda i: [F.when(_phrase(words, i, tuple(p.split())),
                                  F.struct(F.lit(name).alias("label"), i.alias("start"))) for p, name in base]
        return F.array_compact(F.flatten(F.transform(at, lambda i: F.array(*label(i)))))

    def notices(words: Column, at: Column) -> Column:
        offers = F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(
            F.coalesce(F.try_element_at(table, F.get(words, i)), F.array().cast("array<struct<t:int,o:int>>")),
            lambda q: F.struct(q["t"].alias("t"), (i - q["o"]).alias("start"))))))

        def judged(offer: Column) -> Column:
            out = None
            for t, template in enumerate(source):
                made = _notice(words, offer["start"], template, index[t], weight, slack)
                out = F.when(offer["t"] == t, made) if out is None else out.when(offer["t"] == t, made)
            return out
        return F.array_compact(F.transform(offers, judged))

    rows = docs.select(ident(docs, id_column).alias(id_column), _let(words_of(ident(docs, text_column)), told).alias("told"))
    return rows.select(id_column, "told.n_words", "told.base", "told.notices")


def report(docs: DataFrame, *, id_column: str = "doc_id", **settings) -> DataFrame:
    """Counts, places and labels per row. ``score``: 1 with a base phrase, else the largest share of a notice, else 0."""
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    start = F.transform("base", lambda b: b["start"].cast("long"))
    own, all_labels = F.transform("base", lambda b: b["label"]), F.transform("notices", lambda n: n["label"])
    best = F.coalesce(F.array_max(F.transform("notices", lambda n: n["share"])), F.lit(0.0))
    return scan(docs, id_column=id_column, **settings).select(
        id_column, "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"), joined(own).alias("base_labels"),
        joined(F.concat(own, all_labels)).alias("labels"), F.when(F.size("base") > 0, 1.0).otherwise(best).alias("score"), "notices")
