"""License scans by a positional index of rare words, with DataFrame operations only.

A template is a run of words with key phrases that must stand in a file. The index holds one posting for each
template: of the words of its first key phrase the one with the highest inverse document frequency (counted over
all documents), with its place in the template. A template can't be in a file without that word, so of a
file's words only these are looked up, and nothing is lost. A place of the word in the file less its place in the
template is an alignment: the template's other words are met at their relative places from there, which
gives the share of its weight that the file has. A template is found if all its key phrases stand around the
alignment and the share is high enough; one of the base must stand whole.

Texts are split and matched where they are read; nothing is shuffled but the counts of at most as many words as the
templates have, and no two files meet, so no key can be hot.

Defined results: a null text counts as empty and has no words; places are word numbers from 0; rows that repeat an id,
or have none, are judged each; texts of any length are read whole; a label found more than once is named once, and equal
frequencies take the earlier word of the phrase; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.llm.shared import ascii_lower, require_columns

#: What stands between words, once A-Z are lower-cased.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Share of a template's weight that a file must have at an alignment.
SHARE = 0.8
#: Words that a key phrase may stand off the alignment.
SLACK = 8


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def phrases(self) -> tuple[str, ...]:
        return self.keys or (self.text,)


# The base's phrases, and sentences and names of public licenses.
TEMPLATES = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
    Template("gpl-2", "gnu general public license version 2"),
    Template("gpl-3", "gnu general public license version 3"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl", "gnu affero general public license"),
    Template("apache-2.0", "apache license version 2 0"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc0", "cc0 1 0"),
    Template("mpl", "mozilla public license"),
    Template("epl", "eclipse public license"),
    Template("bsl", "boost software license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms", "permitted")),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge", "copy of this software")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "hereby granted")),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", ("in no event will the authors be held liable",)),
)


def _words(text: str) -> Column:
    return F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), GAPS, -1)


def word_weights(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, text_col: str = "text") -> dict[str, float]:
    """Inverse document frequency of each word of the templates, over all documents: ln(1 + n / (1 + documents with it))."""
    vocabulary = sorted({w for t in templates for w in t.words})
    own = F.array_intersect(_words(text_col), F.array(*map(F.lit, vocabulary)))
    counted = docs.select(F.explode(F.concat(own, F.array(F.lit("")))).alias("word")).groupBy("word").count()  # '' stands for the document
    counts = {r["word"]: r["count"] for r in counted.collect()}  # at most a row for each word of the templates
    return {w: math.log(1 + counts.get("", 0) / (1 + counts.get(w, 0))) for w in vocabulary}


def _posting(t: Template, weights: dict[str, float]) -> Column:
    """The template with the word it is looked up by."""
    first, words = t.phrases[0].split(), t.words
    start = next(i for i in range(len(words)) if words[i : i + len(first)] == first)
    at = start + max(range(len(first)), key=lambda i: weights[first[i]])
    return F.struct(
        F.lit(t.label).alias("label"),
        F.lit(t.base).alias("base"),
        F.lit(words[at]).alias("word"),
        F.lit(at).alias("at"),
        F.array(*map(F.lit, words)).alias("words"),
        F.array(*[F.lit(weights[w]) for w in words]).alias("weights"),
        F.lit(sum(weights[w] for w in words) or 1.0).alias("total"),
        F.array(*[F.lit(f" {p} ") for p in t.phrases]).alias("phrases"),
    )


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Sequence[Template] = TEMPLATES,
    share: float = SHARE,
    slack: int = SLACK,
) -> DataFrame:
    """id, n_words and ``found``: an array of (label, base, start, share), a template at a place each, by place and label."""
    require_columns(docs, [id_col, text_col])
    weights = word_weights(docs, templates, text_col)
    postings = [_posting(t, weights) for t in templates]
    lookups = sorted({max(t.phrases[0].split(), key=lambda w: weights[w]) for t in templates})
    rows = docs.select(F.col(id_col).alias("_id"), _words(text_col).alias("_words"))
    words = F.col("_words")
    lead = F.when(F.get(words, F.lit(0)) == "", 1).otherwise(0)
    tail = F.when((F.size(words) > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0)
    spots = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda p: F.get(words, p).isin(lookups))

    def align(p: Column, t: Column) -> Column:
        a, n = p - t["at"], F.size(t["words"])
        same = lambda j: F.get(words, a + j) == F.get(t["words"], j)
        have = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, j: s + F.when(same(j), F.get(t["weights"], j)).otherwise(0.0))
        around = F.slice(words, F.greatest(a - slack, F.lit(0)) + 1, n + 2 * slack)
        near = F.concat(F.lit(" "), F.array_join(around, " "), F.lit(" "))
        whole = F.forall(F.sequence(F.lit(0), n - 1), lambda j: F.coalesce(same(j), F.lit(False)))
        keyed = F.forall(t["phrases"], lambda k: F.contains(near, k))
        part = have / t["total"]
        return F.struct(
            t["label"].alias("label"),
            t["base"].alias("base"),
            (a - lead).cast("long").alias("start"),
            part.alias("share"),
            F.when(t["base"], whole).otherwise(keyed & (part >= share)).alias("ok"),
        )

    met = F.flatten(F.transform(spots, lambda p: F.transform(F.filter(F.array(*postings), lambda t: t["word"] == F.get(words, p)), lambda t: align(p, t))))
    none = F.array().cast("array<struct<label:string,base:boolean,start:bigint,share:double,ok:boolean>>")
    found = F.when(F.arrays_overlap(words, F.array(*map(F.lit, lookups))), F.filter(met, lambda f: f["ok"])).otherwise(none)
    kept = F.transform(found, lambda f: F.struct(f["start"].alias("start"), f["label"].alias("label"), f["base"].alias("base"), f["share"].alias("share")))
    return rows.select(F.col("_id").alias(id_col), (F.size(words) - lead - tail).cast("long").alias("n_words"), F.array_sort(kept).alias("found"))


def names(found: Column) -> Column:
    """The labels of ``found``, distinct, sorted, comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda f: f["label"]))), ",")


def scan_sql(templates: Sequence[Template] = TEMPLATES, share: float = SHARE, slack: int = SLACK) -> str:
    """The same scan of ``documents`` in DuckDB SQL, by trying every template wherever its first key phrase stands."""
    text = lambda s: "'" + s + "'"
    rows = []
    for i, t in enumerate(templates):
        first = t.phrases[0].split()
        at = next(k for k in range(len(t.words)) if t.words[k : k + len(first)] == first)
        lists = (t.words, [f" {p} " for p in t.phrases], first)
        rows.append(f"({i}, {text(t.label)}, {str(t.base).lower()}, {', '.join('[' + ', '.join(map(text, x)) + ']' for x in lists)}, {at})")
    table = ", ".join(rows)
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with d as (select row_number() over () r, doc_id, regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
t(i, label, base, tw, phrases, first, at0) as (values {table}),
v as (select distinct unnest(tw) word from t),
p as (select r, unnest(w) word, generate_subscripts(w, 1) x from d),
c as (select word, count(distinct r) df from p group by word),
g as (select word, ln(1 + (select count(*) from d) / (1 + coalesce(df, 0))) idf from v left join c using (word)),
u as (select i, list(idf order by j) tg from (select i, unnest(tw) word, generate_subscripts(tw, 1) j from t) join g using (word) group by i),
q as (select r, x - at0 x, i, label, base, tw, tg, phrases, w, len(tw) n from p join t on word = first[1] join d using (r) join u using (i) where w[x:x + len(first) - 1] = first),
k as (select r, x - 1 start, label, base,
             list_sum(list_transform(range(1, n + 1), lambda j: case when x + j > 1 and w[x + j - 1] = tw[j] then tg[j] else 0.0 end)) / list_sum(tg) share,
             case when base then w[x:x + n - 1] = tw
                  else len(list_filter(phrases, lambda h: contains(' ' || array_to_string(w[greatest(x - {slack}, 1):greatest(x - {slack}, 1) + n + {2 * slack} - 1], ' ') || ' ', h))) = len(phrases) end ok from q),
m as (select * from k where ok and (base or share >= {share})),
a as (select r, count(*) filter (base) n_base, min(start) filter (base) first_word, max(start) filter (base) last_word,
             string_agg(distinct label, ',' order by label) filter (base) base_labels, string_agg(distinct label, ',' order by label) labels, max(share) score
      from m group by r)
select doc_id, len(w)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word,
       coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, round(coalesce(score, 0.0), 6) score
from d left join a using (r)"""
