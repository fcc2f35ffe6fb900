"""Rule chains as expressions: categories by words, lineages, layer names, score ladders, class decisions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(value: str) -> str:
    """A string as a literal of Spark SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _constant(table: dict[str, list[str]]) -> Column:
    """The table as one array of structs (c, w); parsed at once, as a call for each word would take longer than a query."""
    return F.expr("array(" + ", ".join(f"named_struct('c', {quoted(c)}, 'w', {quoted(w)})" for c, w in V.words(table)) + ")")


def _has_word(text: Column, table: dict[str, list[str]]) -> Column:
    """Whether any word of the table stands in the text: one pass over it."""
    return text.rlike("|".join(re.escape(w) for _, w in V.words(table)))


def _first_word(text: Column, table: dict[str, list[str]]) -> Column:
    """At most one struct (c, w) in an array: the first word of the table that stands in the text. The table is one constant, gone through only where a word stands."""
    words = _constant(table)
    found = F.transform(F.array(text), lambda t: F.slice(F.filter(words, lambda x: F.contains(t, x["w"])), 1, 1))  # the text is made once, not for each word
    return F.when(_has_word(text, table), F.try_element_at(found, F.lit(1))).otherwise(F.slice(words, 1, 0))


def category_by_words(text: str | Column, table: dict[str, list[str]]) -> Column:
    """The first category of which a word stands in the text, whatever the case; null if none."""
    return F.try_element_at(F.transform(_first_word(F.lower(_col(text)), table), lambda x: x["c"]), F.lit(1))


def category_by_keywords(description: str | Column, gene: str | Column | None = None) -> Column:
    """The first keyword decides, unless what follows speaks of inhibition or what precedes of the host."""
    g = F.coalesce(_col(gene), F.lit("")) if gene is not None else F.lit("")
    text = F.lower(F.concat(F.coalesce(_col(description), F.lit("")), F.lit(" "), g))

    def decide(hit: Column) -> Column:
        at = F.position(hit["w"], text)
        after = F.substring(text, at + F.length(hit["w"]), F.lit(30))
        before = F.substring(text, F.greatest(at - 15, F.lit(1)), F.least(at - 1, F.lit(15)))
        about_host = after.contains("inhibitor") | after.contains("inhibition") | before.contains("host")
        return F.when((hit["c"] != "host_interaction") & about_host, F.lit("host_interaction")).otherwise(hit["c"])

    return F.coalesce(F.try_element_at(F.transform(_first_word(text, V.KEYWORDS), decide), F.lit(1)), F.lit("unknown"))


def category_by_evidence(description: str | Column, gene: str | Column | None, domain: str | Column, superfamily: str | Column, process: str | Column, function: str | Column) -> tuple[Column, Column]:
    """(category, source): domains first, then superfamilies, processes, functions, and keywords last."""
    fields = [("pfam", domain, V.DOMAINS), ("superfamily", superfamily, V.SUPERFAMILIES), ("go_bp", process, V.PROCESSES), ("go_mf", function, V.FUNCTIONS)]
    category = F.coalesce(*(category_by_words(field, table) for _, field, table in fields), category_by_keywords(description, gene))
    source = F.coalesce(*(F.when(_has_word(F.lower(_col(field)), table), F.concat(F.lit(f"{name}:"), _col(field))) for name, field, table in fields), F.lit("keywords"))
    return category, source


def ladder(value: str | Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The first step that the value exceeds; null for null."""
    v = _col(value)
    out = F.when(v.isNull(), F.lit(None).cast("string"))
    for limit, name in steps:
        out = out.when(v > limit, F.lit(name))
    return out.otherwise(F.lit(last))


def viral_ladder(v: str | Column) -> Column:
    return ladder(v, [(1.3, "likely viral"), (1.0, "possibly viral"), (0.7, "ambiguous")], "likely non-viral")


def origin_ladder(v: str | Column) -> Column:
    return ladder(v, [(1.1, "RNA-origin"), (0.9, "ambiguous origin")], "DNA-origin")


def mobility_ladder(v: str | Column) -> Column:
    return ladder(v, [(1.2, "mobile element"), (0.8, "possibly mobile")], "chromosomal")


def novelty_ladder(v: str | Column) -> Column:
    return ladder(v, [(0.99, "highly novel (top 1%)"), (0.95, "unusual (top 5%)"), (0.80, "somewhat unusual")], "typical")


def coding_ladder(v: str | Column) -> Column:
    return ladder(v, [(0.8, "strong codon structure"), (0.6, "moderate codon structure"), (0.3, "weak codon structure")], "minimal coding signal")


def origin_scores(similarities: Column) -> dict[str, Column]:
    """Three ratios of a map of similarities by category; an absent category counts 0."""
    of = lambda k: F.coalesce(F.try_element_at(similarities, F.lit(k)), F.lit(0.0))
    floor = F.lit(0.001)
    return {
        "viral_signature": F.greatest(of("phage"), of("rna_virus")) / F.greatest(of("chromosome"), of("cellular"), floor),
        "rna_origin_score": of("rna_virus") / F.greatest(of("phage"), floor),
        "mobile_element_score": (of("phage") + of("plasmid")) / (2 * F.greatest(of("chromosome"), floor)),
    }


#: The classes that aren't viral.
NON_VIRAL = ("cellular", "chromosome", "plasmid")


def viral_score(probabilities: str | Column, classes: list[str]) -> Column:
    """Sum over the viral classes, or the last class if none is."""
    p = _col(probabilities)
    viral = [i for i, c in enumerate(classes) if c not in NON_VIRAL] or [len(classes) - 1]
    out = p[viral[0]]
    for i in viral[1:]:
        out = out + p[i]
    return out


def class_of(probabilities: str | Column, classes: list[str], threshold: float = 0.5) -> Column:
    """Viral at the threshold (the likeliest viral class if there are several), the likeliest other at its complement, else ambiguous."""
    p = _col(probabilities)
    viral = [i for i, c in enumerate(classes) if c not in NON_VIRAL]
    other = [i for i in range(len(classes)) if i not in viral]

    def likeliest(own: list[int]) -> Column:
        top = F.greatest(*(p[i] for i in own)) if len(own) > 1 else p[own[0]]
        return F.coalesce(*(F.when(p[i] == top, F.lit(classes[i])) for i in own))

    score = viral_score(p, classes)
    return (
        F.when(score >= threshold, likeliest(viral) if len(viral) > 1 else F.lit("viral"))
        .when(score <= 1.0 - threshold, likeliest(other) if other else F.lit("cellular"))
        .otherwise(F.lit("ambiguous"))
    )


def triage(score: str | Column, high: float = 0.7, low: float = 0.3) -> Column:
    """Both limits inclusive; what lies between goes to the costly model."""
    s = _col(score)
    return F.when(s >= high, "viral").when(s <= low, "non_viral").otherwise("borderline")


def pseudo_label(score: str | Column, high: float = 0.8, low: float = 0.2) -> Column:
    s = _col(score)
    return F.when(s > high, 1).when(s < low, 0)


#: Length bins, half open.
LENGTH_BINS = ((500, 1000), (1000, 3000), (3000, 5000), (5000, 10000), (10000, 16000))


def length_bin(length: str | Column, bins: tuple[tuple[int, int], ...] = LENGTH_BINS, closed_top: bool = False) -> Column:
    n = _col(length)
    out = None
    for i, (lo, hi) in enumerate(bins):
        inside = (n >= lo) & ((n <= hi) if closed_top and i == len(bins) - 1 else (n < hi))
        out = (out.when if out is not None else F.when)(inside, f"{lo}-{hi}")
    return out.otherwise("other")


def lowest_rank(taxonomy: str | Column) -> Column:
    """The last rank that isn't empty."""
    ranks = F.filter(F.split(_col(taxonomy), ";"), lambda x: F.trim(x) != "")
    return F.coalesce(F.when(F.size(ranks) > 0, F.element_at(ranks, -1)), F.lit("Unclassified"))


def domain_of(lineage: str | Column, other: str = "Other") -> Column:
    """Ordered rules over a lineage or a group's name."""
    x = _col(lineage)
    any_of = lambda *names: x.rlike("|".join(names))
    return (
        F.when(x.startswith("Bacteria"), "Bacteria").when(x.startswith("Archaea"), "Archaea")
        .when(any_of("[Vv]irus", "[Pp]hage"), "Virus").when(any_of("Plant", "Viridiplantae"), "Plant")
        .when(any_of("Fung", "Yeast"), "Fungi").when(any_of("Metazoa", "Animal", "Mammal", "Vertebrat", "Insect"), "Animal")
        .otherwise(other)
    )


def layer_to_service(name: str | Column) -> Column:
    """Native to service layer names; an unknown form is an error."""
    x = _col(name)
    native, service = V.LAYER_PREFIX
    moved = F.concat(F.lit(service), F.substring(x, len(native) + 1, 1 << 20))
    for a, b in V.SUBLAYERS.items():
        moved = F.when(x.endswith(a), F.regexp_replace(moved, re.escape(a) + "$", b)).otherwise(moved)
    return (
        F.when(x.isin(*V.SHARED_LAYERS) | x.startswith(service), x).when(x.startswith(native), moved)
        .otherwise(F.raise_error(F.concat(F.lit("unknown layer name: "), x)))
    )


def layer_to_native(name: str | Column) -> Column:
    x = _col(name)
    native, service = V.LAYER_PREFIX
    moved = F.concat(F.lit(native), F.substring(x, len(service) + 1, 1 << 20))
    moved = F.replace(F.replace(moved, F.lit(".mlp.linear_fc2"), F.lit(".mlp.l3")), F.lit(".mlp.linear_fc1"), F.lit(".mlp.l1"))
    return (
        F.when(x.isin(*V.SHARED_LAYERS) | x.startswith(native), x).when(x.startswith(service), moved)
        .otherwise(F.raise_error(F.concat(F.lit("unknown layer name: "), x)))
    )


def layer_on_large_model(name: str | Column) -> Column:
    """The equivalent layer of the larger model, whose late blocks are silent."""
    x = _col(name)
    block = F.try_to_number(F.regexp_extract(x, r"^blocks\.(\d+)(?:\.|$)", 1), F.lit("999999")).cast("int")
    rest = F.regexp_extract(x, r"^blocks\.\d+\.?(.*)$", 1)
    out = F.when(block > V.LARGE_MODEL_LAST_BLOCK, F.concat(F.lit(f"blocks.{V.LARGE_MODEL_FALLBACK}."), rest))
    for a, b in V.LARGE_MODEL_LAYERS.items():
        out = F.when(x == a, F.lit(b)).otherwise(out)
    return F.coalesce(out, x)


def strip_provirus(name: str | Column) -> Column:
    return F.regexp_replace(_col(name), r"^(.*)\|provirus.*$", "$1")


def top_organism(name: str | Column) -> Column:
    """After the last bar and before the first comma, or before the first underscore."""
    x = _col(name)
    return F.when(x.contains("|"), F.trim(F.substring_index(F.substring_index(x, "|", -1), ",", 1))).otherwise(F.substring_index(x, "_", 1))


def collapse_label(label: str | Column) -> Column:
    """Viral 1, cellular kinds 0, any other null."""
    x = _col(label)
    return F.when(x.isin("chromosome", "plasmid"), 0).when(x == "viral", 1)


def gc_bin(share: str | Column, edges: tuple[float, ...] = (0.3, 0.4, 0.5, 0.6, 0.7)) -> Column:
    """Half-open bins of a share, named in percent."""
    x = _col(share)
    out = F.when(x < edges[0], f"<{edges[0]:.0%}")
    for lo, hi in zip(edges, edges[1:]):  # noqa: B905
        out = out.when(x < hi, f"{lo:.0%}-{hi:.0%}")
    return out.otherwise(f">={edges[-1]:.0%}")


def mapped(name: str | Column, table: dict[str, str], other: str) -> Column:
    """An exact lookup in a small table."""
    x = _col(name)
    return F.coalesce(*(F.when(x == k, F.lit(v)) for k, v in table.items()), F.lit(other))


def is_suspect(label: str | Column, score: str | Column, least: float = 0.8) -> Column:
    """A sequence that is labelled cellular but scores high."""
    return (_col(label) == "cellular") & (_col(score) >= least)


def is_coding(flag: str | Column, category: str | Column, prefix: str = "noncoding") -> Column:
    """The flag, or, where it is null, whether the category doesn't begin with the prefix."""
    return F.coalesce(_col(flag), ~_col(category).startswith(prefix))


def cosine_ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, with a tenth of a billionth added to b."""
    return _col(a) / (_col(b) + 1e-10)


def vote_of(probabilities: str | Column, classes: list[str], positive: str) -> Column:
    """True only if the likeliest class is the positive one itself: its sub-classes don't count."""
    p = _col(probabilities)
    return F.array_position(p, F.array_max(p)) == classes.index(positive) + 1
