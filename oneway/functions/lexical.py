"""Lexical columns: domain labels, entropy, n-gram features.  Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bigrams that are common in English, and frequent words; presence of either marks a name as language-like.
COMMON_BIGRAMS = (
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng "
    "se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si "
    "om ur ca el ta la ns di fo ho pe ec pr no ct us ac ot il tr ly nc et ut "
    "ss so rs un lo wa ge ie wh ee wi em ad ol rt po we na ul ni ts mo ow pa "
    "im mi ai sh up da su ap ay ci ld ry rd os ov um do go ba bi fi oo "
    "ph gh ck"
).split()
COMMON_WORDS = (
    "the and for you are with this that have from your they will one all "
    "about time work life world play news shop mail cloud data secure "
    "login online store home page group team best free live game photo "
    "video music money market green water light house money power"
).split()
LONG_WORDS = sorted({w for w in COMMON_WORDS if len(w) >= 4})


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character; 0 for empty or null."""
    cs = chars(text)
    n = F.length(text).cast("double")
    counts = F.transform(F.array_distinct(cs), lambda c: n - F.length(F.replace(text, c)).cast("double"))
    bits = F.aggregate(counts, F.lit(0.0), lambda s, k: s - k / n * F.log2(k / n))
    return F.when(n > 0, F.greatest(F.lit(0.0), bits)).otherwise(0.0)


def trimmed(qname: Column) -> Column:
    return F.lower(F.btrim(qname, F.lit(".")))


def second_level(qname: Column) -> Column:
    """The last two labels in lower case; a name of one label is returned as it came."""
    q = trimmed(qname)
    return F.when(F.contains(q, F.lit(".")), F.substring_index(q, ".", -2)).otherwise(qname)


def subdomain(qname: Column, domain: Column) -> Column:
    """What stands before the domain as a string suffix, without outer dots."""
    q = trimmed(qname)
    parts = F.split(q, "[.]")
    cut = F.btrim(F.substring(q, F.lit(1), F.length(q) - F.length(domain)), F.lit("."))
    return F.when(q.endswith(domain), cut).otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 2, F.lit(0))), "."))


def heuristic_label(qname: Column) -> Column:
    """The second label from the end; the only label of a bare name."""
    return F.substring_index(F.substring_index(trimmed(qname), ".", -2), ".", 1)


def model_label(qname: Column) -> Column:
    """The leftmost label."""
    return F.substring_index(trimmed(qname), ".", 1)


#: A letter before another one, and one that begins a common bigram: matches of one letter each, so overlapping pairs all count.
LETTER_PAIR = "[a-z](?=[a-z])"
COMMON_PAIR = "|".join(f"{a}(?=[{''.join(sorted(b[1] for b in COMMON_BIGRAMS if b[0] == a))}])" for a in sorted({b[0] for b in COMMON_BIGRAMS}))


def label_features(label: Column) -> dict[str, Column]:
    """Features of a label, ratios rounded to 3 digits as scoring expects them."""
    n = F.length(label)
    digits, vowels, letters = (F.regexp_count(label, F.lit(p)) for p in ("[0-9]", "[aeiou]", "[a-z]"))
    pairs, hits = (F.regexp_count(label, F.lit(p)) for p in (LETTER_PAIR, COMMON_PAIR))
    words = sum((F.coalesce(F.contains(label, F.lit(w)).cast("int"), F.lit(0)) for w in LONG_WORDS), F.lit(0))
    runs = F.transform(F.regexp_extract_all(label, F.lit("([b-df-hj-np-tv-z]+)"), F.lit(1)), lambda r: F.length(r))
    share = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 3)
    return {
        "label_length": n, "entropy": F.round(entropy(label), 3), "digit_ratio": share(digits, n), "vowel_ratio": share(vowels, letters),
        "max_cons_run": F.coalesce(F.array_max(runs), F.lit(0)), "englishness": share(hits, pairs),
        "dict_word_hits": words,
    }


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the code points of a string."""
    codes = F.transform(chars(text), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(4294967295))


def ngram_buckets(label: Column, dim: int = 16384, longest: int = 4) -> Column:
    """Hash buckets of all 1- to ``longest``-grams, repeats included."""
    n = F.length(label)

    def of_length(k: int) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(label, i, F.lit(k)))
        return F.when(n >= k, some).otherwise(F.array().cast("array<string>"))

    grams = [of_length(k) for k in range(1, longest + 1)]
    return F.transform(F.concat(*grams), lambda g: fnv1a(g) % dim)
