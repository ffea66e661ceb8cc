"""Column expressions on sequences. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from seqloom.alphabets import COLUMN_ALPHABET, ENTROPY_ALPHABET

_OPEN, _CLOSE = "\u0001", "\u0002"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once.

    An expression that mentions its input many times would otherwise repeat it, because the optimizer
    inlines columns into filters, where common parts are not shared.
    """
    return F.transform(F.array(value), use)[0]


def _blank_runs(seq: Column, run: str, char: str) -> Column:
    # Bracket every run, then walk each bracket letter by letter from its opening mark (\G keeps the
    # walk inside the bracket), so the length never changes and the cost stays linear.
    marked = F.regexp_replace(seq, run, _OPEN + "$0" + _CLOSE)
    walked = F.regexp_replace(marked, f"{_OPEN}[A-Z]|\\G(?!^)[A-Z]", char)
    return F.translate(walked, _CLOSE, "")


def mask_mono_repeats(seq: Column, min_run: int = 5, char: str = "X") -> Column:
    """Runs of at least ``min_run`` equal letters become ``char``, same length."""
    return _blank_runs(seq, "([A-Z])\\1{%d,}" % (min_run - 1), char)


def mask_pair_repeats(seq: Column, min_repeats: int = 3, char: str = "X") -> Column:
    """A two-letter motif repeated at least ``min_repeats`` times becomes ``char``, same length."""
    return _blank_runs(seq, "([A-Z]{2})\\1{%d,}" % (min_repeats - 1), char)


def clean_repeats(
    seq: Column,
    mono_threshold: int = 5,
    pair_threshold: int = 3,
    char: str = "X",
    mono_char: str | None = None,
    pair_char: str | None = None,
) -> Column:
    """Single-letter runs first, then dipeptide runs on the result."""
    mono = mask_mono_repeats(seq, mono_threshold, mono_char or char)
    return mask_pair_repeats(mono, pair_threshold, pair_char or char)


def sequence_entropy(seq: Column) -> Column:
    """Shannon entropy in bits over the 21 letters; the denominator is the full length."""

    def term(p: Column) -> Column:
        return F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))

    def total(s: Column) -> Column:
        size = F.length(s)
        shares = F.transform(
            F.array(*[F.lit(c) for c in ENTROPY_ALPHABET]),
            lambda c: (size - F.length(F.replace(s, c, F.lit("")))) / F.greatest(size, F.lit(1)),
        )
        return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc + term(p))

    return bind(seq, total)


def pad_sequence(seq: Column, start: Column, full_len: Column) -> Column:
    """Gaps before and after, so that the row is ``full_len`` wide."""
    tail = full_len - start - F.length(seq)
    return F.concat(F.repeat(F.lit("-"), start), seq, F.repeat(F.lit("-"), tail))


def strip_gaps(seq: Column) -> Column:
    return F.replace(seq, F.lit("-"), F.lit(""))


def letters(seq: Column) -> Column:
    """The characters as an array (empty for the empty string)."""
    return F.filter(F.split(seq, ""), lambda c: c != "")


def hamming_distance(left: Column, right: Column) -> Column:
    """Number of differing positions; unequal lengths raise."""
    differs = F.zip_with(F.split(left, ""), F.split(right, ""), lambda x, y: (x != y).cast("long"))
    total = F.aggregate(differs, F.lit(0).cast("long"), lambda acc, d: acc + d)
    return F.when(F.length(left) == F.length(right), total).otherwise(
        F.raise_error(F.lit("Hamming distance needs sequences of equal length")).cast("long")
    )


def fractional_distance(left: Column, right: Column) -> Column:
    return F.try_divide(hamming_distance(left, right).cast("double"), F.length(left))


def identity(left: Column, right: Column) -> Column:
    """Share of equal positions, computed as matches / length."""
    size = F.length(left)
    return F.try_divide((size - hamming_distance(left, right)).cast("double"), size)


def spaced_input(seq: Column, prefix: str) -> Column:
    """Task prefix followed by the residues, separated by blanks."""
    return F.concat(F.lit(prefix + " "), F.array_join(letters(seq), " "))


def strip_spaces(decoded: Column) -> Column:
    return F.replace(decoded, F.lit(" "), F.lit(""))


def finite_scores(scores: Column, limit: float = 1e9) -> Column:
    """NaN becomes 0, everything else is clamped to ``[-limit, limit]``."""
    return F.transform(
        scores, lambda x: F.greatest(F.least(F.nanvl(x, F.lit(0.0)), F.lit(limit)), F.lit(-limit))
    )


def argmax_letter(scores: Column, alphabet: str) -> Column:
    """The letter at the first position of the largest score."""
    return F.substr(F.lit(alphabet), F.array_position(scores, F.array_max(scores)).cast("int"), F.lit(1))


def chain_array(query: Column) -> Column:
    return F.split(query, ":")


def is_homo_oligomer(chains: Column) -> Column:
    return (F.size(chains) > 1) & (F.size(F.array_distinct(chains)) == 1)


def as_double(value: Column) -> Column:
    """Empty text counts as null."""
    return F.nullif(value, F.lit("")).try_cast("double")


def generation_kwargs(conf: Column, cache: Column) -> Column:
    """Decoding parameters with the cache mode set, unless that is null or ``default``."""
    extra = F.create_map(F.lit("cache_implementation"), cache)
    others = F.map_filter(conf, lambda k, _: k != "cache_implementation")
    return F.when(cache.isNull() | (cache == "default"), conf).otherwise(F.map_concat(others, extra))


def cache_modes(modes: Column) -> Column:
    """Null or an empty list means one unnamed mode."""
    one_null = F.array(F.lit(None).cast("string"))
    return F.when(modes.isNull() | (F.size(modes) == 0), one_null).otherwise(modes)


def cache_modes_of(mode: Column) -> Column:
    """The same for a single text value."""
    return F.array(mode)


def column_letter(aa: Column) -> Column:
    """Recode to the 22 column letters; anything unknown is X."""
    return F.when(F.instr(F.lit(COLUMN_ALPHABET), aa) > 0, aa).otherwise(F.lit("X"))


def safe_key(text: Column) -> Column:
    """Anything but letters and digits becomes an underscore (Unicode aware)."""
    return F.regexp_replace(text, "[^\\p{L}\\p{N}]", "_")


def safe_variant_key(strategy: Column, variant: Column, cache: Column) -> Column:
    """File-system key of a sweep variant; dots, equals, dashes and underscores are kept."""
    text = F.concat_ws("__", strategy, variant, F.concat(F.lit("cache="), F.coalesce(cache, F.lit("None"))))
    return F.regexp_replace(text, "[^\\p{L}\\p{N}._=-]", "_")


def variant_label(strategy: Column, conf: Column) -> Column:
    """Parameter label of a strategy from its settings (map of text values)."""

    def setting(name: str, default: str) -> Column:
        return F.coalesce(conf[name], F.lit(default))

    return (
        F.when(strategy == "encoder_perturb", F.concat(F.lit("sigmas="), setting("noise_scales", "[]")))
        .when(
            strategy == "diverse_beam",
            F.concat(F.lit("beams="), setting("num_beams", "8"), F.lit(",dp="), setting("diversity_penalty", "1.0")),
        )
        .when(
            strategy == "round_trip",
            F.concat(F.lit("rounds="), setting("n_rounds", "4"), F.lit(",seeds="), setting("n_seeds", "8")),
        )
        .when(strategy == "3di_perturb", F.concat(F.lit("rates="), setting("mutation_rates", "[]")))
        .otherwise(F.lit(""))
    )


def mean_score(values: Column) -> Column:
    """Mean of an array, null when it is empty or absent."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(values) > 0, total / F.size(values))
