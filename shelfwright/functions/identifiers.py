"""Identifiers, hashes and small numeric functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwright.functions.text import strip


def gtin(c: Column) -> Column:
    """A valid GTIN of 8, 12, 13 or 14 digits as 14 digits; NULL for wrong lengths, check digits and all zeros."""
    v = strip(c)
    digits = F.transform(F.split(F.reverse(v), ""), lambda d: d.cast("int"))
    total = F.aggregate(F.transform(digits, lambda d, i: d * F.when(i % 2 == 0, 1).otherwise(3)), F.lit(0), lambda a, d: a + d)
    valid = v.rlike("^([0-9]{8}|[0-9]{12,14})$") & ~v.rlike("^0+$")
    return F.when(valid, F.when(total % 10 == 0, F.lpad(v, 14, "0")))


def listing_url(c: Column) -> Column:
    """Scheme and host in lower case, path and query kept, fragment dropped; NULL for what is no http(s) URL."""
    v = strip(c)
    head = F.regexp_extract(v, r"^((?i)https?://[^/?#\s]+)", 1)
    rest = F.regexp_extract(v, r"^(?i)https?://[^/?#\s]+([^#\s]*)", 1)
    return F.when(head != "", F.concat(F.lower(head), rest))


def hash_rank(seed: str, *parts: Column) -> Column:
    """A reproducible rank: SHA-256 of the seed and the parts."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *parts), 256)


def hash_role(salt: str, c: Column, roles: int = 3) -> Column:
    """The first 60 bits of SHA-256 of salt and value, modulo the number of roles."""
    return (F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(salt), c), 256), 1, 15), 16, 10).cast("long") % roles).cast("int")


def hash_fraction(salt: str, c: Column) -> Column:
    """A reproducible fraction in [0, 1) from 52 bits of SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(salt), c), 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def wilson_lower(successes: Column, n: Column, z: float = 1.6448536269514722) -> Column:
    """Lower bound of the Wilson score interval; NULL without trials."""
    p = successes / n
    centre = p + F.lit(z * z) / (2 * n)
    spread = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n))
    return F.when(n > 0, (centre - spread) / (1 + F.lit(z * z) / n))


def bernoulli_kl(a: Column, b: Column) -> Column:
    """Kullback-Leibler divergence of two Bernoulli distributions, 0 log 0 being 0."""
    left = F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    right = F.when(a < 1, (1 - a) * F.log((1 - a) / (1 - b))).otherwise(0.0)
    return left + right


def tempered(p: Column, temperature: float) -> Column:
    """An array of probabilities raised to 1/temperature and normalised; zeros stay zero."""
    powered = F.transform(p, lambda x: F.when(x > 0, F.pow(x, F.lit(1.0 / temperature))).otherwise(0.0))
    total = F.aggregate(powered, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powered, lambda x: x / total)


def char_ngrams(c: Column, k: int) -> Column:
    """The distinct character k-grams of a text, sorted; a shorter text is its own only one."""
    n = F.length(c)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - k + 1)), lambda i: F.substring(c, i, F.lit(k)))
    return F.array_sort(F.array_distinct(grams))


def word_ngrams(words: Column, k: int) -> Column:
    """The distinct runs of k words of an array; an array of fewer words has none."""
    n = F.size(words) - k + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " ")))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def name_key(c: Column) -> Column:
    """Letters and digits of a name in lower case, single blanks between words."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def _nul_joined(first: str, *parts: Column) -> Column:
    return F.concat_ws("\x00", F.lit(first), *[p.cast("string") for p in parts])


def seeded_rank(seed: str, *parts: Column) -> Column:
    """A reproducible rank: SHA-256 of the seed and the parts, with zero characters between them."""
    return F.sha2(_nul_joined(seed, *parts), 256)


def _first_bits(digest: Column) -> Column:
    """The first 64 bits of a hexadecimal digest as a decimal."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def group_role(salt: str, group: Column, roles: int = 3) -> Column:
    """The first 64 bits of SHA-256 of salt and group, modulo the number of roles."""
    return (_first_bits(F.sha2(_nul_joined(salt, group), 256)) % roles).cast("int")


def unit_fraction(salt: str, c: Column) -> Column:
    """A reproducible fraction in [0, 1) from 64 bits of SHA-256 of salt and value."""
    return _first_bits(F.sha2(_nul_joined(salt, c), 256)).cast("double") / F.lit(float(1 << 64))


def raw_key(c: Column) -> Column:
    """A value in lower case with single blanks; '' for NULL and the words that stand for missing."""
    v = F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    return F.when(v.isNull() | v.isin("", "null", "none", "nan"), "").otherwise(v)


def block_key(c: Column) -> Column:
    """A brand's name without blanks."""
    return F.replace(name_key(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit(""))


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller set that the other one has; 0 where one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def dice(a: Column, b: Column) -> Column:
    """Twice the common elements over the elements of both; 0 where both are empty."""
    both = F.size(a) + F.size(b)
    return F.when(both > 0, 2 * F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def padded_ngrams(c: Column, k: int = 3) -> Column:
    """The distinct character k-grams of a text with a blank at both ends, sorted."""
    return char_ngrams(F.concat(F.lit(" "), c, F.lit(" ")), k)


def seller_key(seller: Column, sku: Column) -> Column:
    """Seller and stock number as one key; NULL where either is missing."""
    s, k = F.lower(strip(seller)), F.lower(strip(sku))
    return F.when(~s.isin("", "null") & ~k.isin("", "null"), F.concat_ws("\x00", s, k))


def effective_wilson(successes: Column, n: Column, effective: Column, z: float = 1.6448536269514722) -> Column:
    """The lower Wilson bound of a share whose n clustered rows are worth `effective` independent ones."""
    return wilson_lower(successes / n * effective, effective, z)


def kl_lower(share: Column, n: Column, error: float, steps: int = 60) -> Column:
    """The least q below a share for which n times the divergence of share and q stays within log(1 / error), by bisection."""
    limit = F.lit(-math.log(error))
    zero = F.struct(F.lit(0.0).alias("low"), share.cast("double").alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        q = (acc["low"] + acc["high"]) / 2
        wide = n * bernoulli_kl(share, F.greatest(q, F.lit(1e-300))) > limit
        return F.struct(F.when(wide, q).otherwise(acc["low"]).alias("low"), F.when(wide, acc["high"]).otherwise(q).alias("high"))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, halve)["high"])


def top_entries(m: Column, k: int) -> Column:
    """The k entries (label, p) of a map of probabilities with the greatest p, ties by label."""
    entries = F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("m"), e["key"].alias("label")))
    return F.transform(F.slice(F.array_sort(entries), 1, k), lambda e: F.struct(e["label"].alias("label"), (-e["m"]).alias("p")))
