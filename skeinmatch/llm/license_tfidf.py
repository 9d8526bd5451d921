"""Licence scans (operator 6), in DataFrame operations alone.

Sentences of a text that may state a licence are compared with licence templates by the cosine of sparse TF-IDF vectors; then
files without a licence of their own inherit that of the nearest ancestor directory with a licence file, by joins on the paths.

Which sentences may: by Cauchy's inequality one that lacks terms which hold over 1 - THRESHOLD**2 of a template's
squared length cannot reach THRESHOLD. So a sentence must hold one of those terms of some template; the test loses nothing.

Three kinds of spans are scored, each in a vector space of its own: lines and sentences against TEMPLATES; lines and sentences, also over
line ends, against the wordings, titles and SPDX ids of `wordings`; and runs of words from the start of a line or sentence against the
passages of headers and whole licence texts in `licence_texts`. A text states the licence of the best cosine of all.

Cauchy's inequality also bounds them from both sides: such a span must hold as many different terms as reach THRESHOLD**2 of a
template's squared length, and of its own squared length no more than 1 - THRESHOLD**2 may be of terms that no template holds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

THRESHOLD = 0.75
# The short notices by which these licences are commonly stated.
TEMPLATES = {
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, version 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
# Words of every day, which the test for candidate sentences leans on last.
COMMON = frozenset("a an and are as at be by file for free from in into is it of on or released terms that the this to under version was which with work".split())
# The names of each licence; that without a licence are those of families, which state no version and so no licence.
NAMES = {
    "": ["GNU General Public License", "GNU GPL", "GNU Lesser General Public License", "GNU LGPL", "GNU Affero General Public License", "GNU AGPL", "BSD License", "Creative Commons License", "Apache License", "Mozilla Public License", "GNU General Public License, version 1", "GNU Library General Public License, version 2", "MIT", "ISC", "BSD", "Apache", "Mozilla", "Creative Commons", "General Public", "Universal"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD License", "0BSD License"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPLv3", "AGPLv3", "AGPL-3.0 License", "GNU Affero General Public License, version 3 or later", "GNU Affero General Public License version 3, 19 November 2007"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License v2.0", "Apache-2.0 License", "Apache License Version 2.0, January 2004"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause License", "BSD 2-Clause Simplified License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD-3-Clause License", "BSD 3-Clause New or Revised License"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0", "CC BY 4.0", "CC-BY-4.0 License", "Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC-4.0 License", "Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA-4.0 License", "Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0", "CC0-1.0 License", "Creative Commons Zero 1.0 Universal", "CC0 1.0 Universal Public Domain Dedication"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU General Public License, version 2.0", "GNU GPLv2", "GPLv2", "GPL-2.0 License", "GNU GPL version 2", "GNU General Public License, version 2 or later", "GNU General Public License Version 2, June 1991"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU General Public License, version 3.0", "GNU GPLv3", "GPLv3", "GPL-3.0 License", "GNU GPL version 3", "GNU General Public License, version 3 or later", "GNU General Public License Version 3, 29 June 2007"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPLv2.1", "LGPLv2.1", "LGPL-2.1 License", "GNU Lesser General Public License, version 2.1 or later", "GNU Lesser General Public License Version 2.1, February 1999"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU Lesser General Public License, version 3.0", "GNU LGPLv3", "LGPLv3", "LGPL-3.0 License", "GNU Lesser General Public License, version 3 or later", "GNU Lesser General Public License Version 3, 29 June 2007"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0", "MPL-2.0 License"],
    "Unlicense": ["The Unlicense", "The Unlicense License"],
}
SPDX_SUFFIXES = ["", "-only", "-or-later"]
#: Words of a passage, without STOP: long enough for a file's header, and for a paragraph of a licence.
PASSAGE_TERMS = (20, 60)
# Words that say nothing of a licence; passages are compared without STOP, names without FRAME.
STOP = COMMON - frozenset("file free released terms version work".split()) | frozenset("all also any been but can do each had has have he her his if its may more most no not one other our out over she should so some such than their them then there these they those through up upon was we were what when where whether who will would you your".split())
FRAME = COMMON | frozenset("available can code distributed file found licensed made project see software source subject uses".split())
TEXTS = Path(__file__).with_name("licence_texts")
_TERM = r"[a-z0-9][a-z0-9.\-]*[a-z0-9]|[a-z0-9]"


def template_weights(templates: dict[str, str] = TEMPLATES) -> tuple[list[tuple[str, str, float]], dict[str, float], float, list[str]]:
    """(template, term, unit weight) rows; idf of each term; idf of any other; the terms of which a sentence must hold one.

    The idf comes from the templates, log((1 + n) / (1 + df)) + 1, so a score depends on the sentence and the templates alone."""
    counts = {k: Counter(re.findall(_TERM, t.lower())) for k, t in templates.items()}
    df = Counter(w for c in counts.values() for w in c)
    n = len(templates)
    idf = {w: math.log((1 + n) / (1 + f)) + 1 for w, f in df.items()}
    rows, needed = [], set()
    for k, c in counts.items():
        v = {w: f * idf[w] for w, f in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        rows += [(k, w, x / norm) for w, x in v.items()]
        mass = 0.0
        for w, x in sorted(v.items(), key=lambda p: (p[0] in COMMON, -p[1], -len(p[0]), p[0])):
            needed.add(w)
            mass += (x / norm) ** 2
            if mass > 1 - THRESHOLD**2 + 1e-9:
                break
    return rows, idf, math.log(1 + n) + 1, sorted(needed)


def wordings() -> dict[str, str]:
    """The names and SPDX ids as templates, without FRAME, by licence, tab and number."""
    made = [(k, name) for k, names in NAMES.items() for name in names]
    made += [(k, f"SPDX-License-Identifier: {k}{x}") for k in NAMES if k for x in (SPDX_SUFFIXES if "GPL" in k else [""])]
    words = ((k, [w for w in re.findall(_TERM, t.lower()) if w not in FRAME]) for k, t in made)
    return _told_apart((k, " ".join(w), w) for k, w in words)


def passages(terms: int) -> dict[str, str]:
    """The first terms, without STOP, from each paragraph of the licence texts, as templates; each counts once, so that no repeated word stands for a passage."""
    made = []
    for path in sorted(TEXTS.glob("*.txt")):
        license, text = path.stem.removesuffix("-header"), path.read_text().lower()
        for start in [0, *(m.end() for m in re.finditer(r"\n\s*\n", text))]:
            words = [w for w in re.findall(_TERM, text[start:]) if w not in STOP][:terms]
            if len(words) == terms:
                made.append((license, " ".join(dict.fromkeys(words)), set(words)))
    return _told_apart(made)


def _told_apart(made) -> dict[str, str]:
    """The (licence, text, words) as templates, without repeats and without those that two licences share."""
    owners: dict[tuple, dict[str, str]] = {}
    for license, text, words in made:
        owners.setdefault(tuple(sorted(words)), {}).setdefault(license, text)
    return {f"{k}\t{i}": t for i, (k, t) in enumerate(p for x in owners.values() if len(x) == 1 for p in x.items())}


def _any_of(words: list[str]) -> str:
    """A pattern for any of the words, as a tree of their letters, so that a word of the text is compared letter by letter."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    ends = heads.pop("", None) is not None
    made = "|".join(re.escape(h) + (_any_of(rest) if rest != [""] else "") for h, rest in sorted(heads.items()))
    return f"(?:{made}){'?' if ends else ''}" if made else ""


def holds(needed: list[str]) -> str:
    return r"(?<![a-z0-9])" + _any_of(needed) + r"(?![a-z0-9])"


def sentences(files: DataFrame, needed: list[str]) -> DataFrame:
    """(id, at, sentence in lower case) for the sentences that hold a needed term."""
    pattern = r"(?<![a-z0-9])(?:" + "|".join(re.escape(w) for w in needed) + r")(?![a-z0-9])"
    held = files.where(F.col("text").rlike("(?i)" + pattern)).select("id", F.posexplode(F.split("text", r"\n|(?<=[.!?])\s+")).alias("at", "sentence"))
    return held.select("id", "at", F.lower("sentence").alias("sentence")).where(F.col("sentence").rlike(pattern))


def vocabulary(templates: dict[str, str]) -> tuple[list[str], int]:
    """The terms of the templates, and how many different ones a span must hold at least to reach THRESHOLD with any template."""
    by_template: dict[str, list[float]] = {}
    rows = template_weights(templates)[0]
    for k, _, x in rows:
        by_template.setdefault(k, []).append(x * x)
    least = []
    for masses in by_template.values():
        total, count = 0.0, 0
        for x in sorted(masses, reverse=True):
            total, count = total + x, count + 1
            if total >= THRESHOLD**2 - 1e-5:
                break
        least.append(count)
    return sorted({w for _, w, _ in rows}), min(least)


def _words(text, without):
    return F.filter(F.regexp_extract_all(text, F.lit(f"({_TERM})"), F.lit(1)), lambda w: ~w.isin(*sorted(without)))


def _likely(words, known: list[str], least: int):
    """Whether a span of these words can reach THRESHOLD. No other term weighs more than an unknown one, so k known terms have a squared length of k * k of its at most."""
    held = F.filter(words, lambda w: w.isin(*known))
    k = F.size(held)
    return (F.size(F.array_distinct(held)) >= least) & ((F.size(words) - k) * (THRESHOLD**2 - 1e-5) <= (1 - THRESHOLD**2 + 1e-5) * k * k)


def joined_sentences(files: DataFrame, templates: dict[str, str]) -> DataFrame:
    """(id, at, terms without FRAME) for the lines, the sentences of a line, and the sentences over line ends up to an empty line, that can reach THRESHOLD."""
    pattern = holds(template_weights(templates)[3])
    lower = files.select("id", F.lower("text").alias("text")).where(F.col("text").rlike(pattern))
    joined = F.regexp_replace("text", r"\r?\n[ \t]*(?:[#*;%!|]+|//+|--+)?[ \t]*(?=\S)", " ")
    ways = (F.split("text", r"\n"), F.split("text", r"\n|(?<=[.!?])\s+"), F.split(joined, r"\n|(?<=[.!?])\s+"))
    spans = lower.select("id", F.explode(F.array_distinct(F.concat(*ways))).alias("sentence")).where(F.col("sentence").rlike(pattern))
    words = spans.select("id", _words("sentence", FRAME).alias("words")).where(_likely(F.col("words"), *vocabulary(templates)))
    return words.select("id", F.array_join("words", " ").alias("sentence")).distinct().select("id", F.xxhash64("sentence").alias("at"), "sentence")


def windows(files: DataFrame, kinds: dict[int, dict[str, str]]) -> DataFrame:
    """(id, n, at, different terms) for the runs of n terms, without STOP, from the start of each line and sentence, that can reach THRESHOLD with a template of kinds[n].

    First go the texts that hold fewer different terms of the templates than any passage needs."""
    held = {n: vocabulary(x) for n, x in kinds.items()}
    pattern = holds(sorted({w for known, _ in held.values() for w in known}))
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    lower = files.select("id", F.lower("text").alias("text")).where(F.size(found) >= min(least for _, least in held.values()))
    lines = lower.select("id", F.transform(F.split("text", r"\n|(?<=[.!?])\s+"), lambda x: _words(x, STOP)).alias("lines"))
    starts = F.aggregate("lines", F.array(F.lit(1)), lambda at, x: F.concat(at, F.array(F.element_at(at, -1) + F.size(x))))
    counted = lines.select("id", F.flatten("lines").alias("words"), F.array_distinct(starts).alias("starts"))
    of = lambda s: F.array(*(F.struct(F.lit(n).alias("n"), F.array_distinct(F.slice("words", s, n)).alias("words")) for n in kinds))
    runs = counted.select("id", F.explode(F.flatten(F.transform("starts", of))).alias("run")).select("id", "run.*")
    likely = reduce(lambda x, y: x | y, ((F.col("n") == n) & _likely(F.col("words"), *held[n]) for n in kinds))
    return runs.where(likely).select("id", "n", F.array_join("words", " ").alias("sentence")).distinct().select("id", "n", F.xxhash64("sentence").alias("at"), "sentence")


def scores(spans: DataFrame, templates: dict[str, str], label: str) -> DataFrame:
    """spans (id, at, sentence): id, license, cosine for those of THRESHOLD or over; a span nearest to a family's name states none."""
    spark = spans.sparkSession
    rows, idf, other, _ = template_weights(templates)
    terms = spark.createDataFrame([(w, x) for w, x in idf.items()], "term string, idf double")
    weights = spark.createDataFrame(rows, "license string, term string, weight double")
    words = written(spans, label).select("id", "at", F.explode(F.regexp_extract_all("sentence", F.lit(f"({_TERM})"), F.lit(1))).alias("term"))
    tf = words.groupBy("id", "at", "term").agg(F.count("*").alias("tf")).join(F.broadcast(terms), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other)))
    norm = tf.groupBy("id", "at").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = tf.join(F.broadcast(weights), "term").groupBy("id", "at", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norm, ["id", "at"]).select("id", "at", F.substring_index("license", "\t", 1).alias("license"), F.round(F.col("dot") / F.col("norm"), 6).alias("cosine"))
    best = scored.where(F.col("cosine") >= THRESHOLD).groupBy("id", "at").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "license")).alias("b"))
    return best.where("b.license != ''").select("id", "b.license", (-F.col("b.less")).alias("cosine"))


def own_licenses(files: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """files (id, text): id, license, cosine of the best template, wording or passage at THRESHOLD or over (ties: first by name); files without one are left out."""
    files = files.where("id is not null")
    said, held = wordings(), {n: passages(n) for n in PASSAGE_TERMS}
    lines = sentences(files, template_weights(templates)[3]).where(_likely(F.regexp_extract_all("sentence", F.lit(f"({_TERM})"), F.lit(1)), *vocabulary(templates)))
    scored = [scores(lines, templates, "sentences"), scores(joined_sentences(files, said), said, "wordings")]
    runs = written(windows(files, held), "runs")
    scored += [scores(runs.where(F.col("n") == n).drop("n"), x, "passages") for n, x in held.items()]
    best = reduce(DataFrame.union, scored).groupBy("id", "license").agg(F.max("cosine").alias("cosine")).groupBy("id").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "license")).alias("b"))
    return written(best.select("id", "b.license", (-F.col("b.less")).alias("cosine")), "licenses")


def ancestors(path):
    """The directories above a path, nearest last; the root is the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def licenses(files: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """files (id, path, text, is_license_file): id, path, license, cosine, source (header, inherited or none), inherited_from (a directory).

    A file with a licence of its own keeps it. Else it takes that of the licence file in the nearest directory above; of several in one
    directory the smallest id that states a licence. Null or empty text states none; a null path inherits none; equal ids share what any of them states.
    Licences whose cosines tie go by their names. Very long texts are read whole. Repeated rows repeat, no rows give none, other columns
    are not read; a null is_license_file is no. Directories are few beside files, so only they meet their ancestors."""
    own = own_licenses(files.select("id", "text"), templates)
    named = files.select("id", "path", "is_license_file").join(own, "id", "left").withColumn("dir", F.regexp_replace("path", r"(^|/)[^/]*$", ""))
    stated = named.where("is_license_file and license is not null and path is not null").groupBy(F.col("dir").alias("above")).agg(F.min_by("license", "id").alias("given"))
    dirs = named.where("path is not null").select("dir").distinct()
    over = dirs.select("dir", F.posexplode(ancestors(F.concat("dir", F.lit("/x")))).alias("depth", "above")).where("dir != '' or depth = 0")
    near = over.join(stated, "above").groupBy("dir").agg(F.max_by(F.struct("above", "given"), "depth").alias("near"))
    out = named.join(near, "dir", "left")
    inherited = F.col("license").isNull() & F.col("near").isNotNull()
    return out.select("id", "path", F.coalesce("license", "near.given").alias("license"), "cosine", F.when(F.col("license").isNotNull(), "header").when(inherited, "inherited").otherwise("none").alias("source"), F.when(inherited, F.col("near.above")).alias("inherited_from"))
