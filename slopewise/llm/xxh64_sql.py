"""XXH64 as SQL text, for engines that have no such function, from the published algorithm."""

from __future__ import annotations

# The five primes of the algorithm.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_SIZE = 1 << 64


def _wide(x: str) -> str:
    return f"({x})::UHUGEINT"


def _wrap(x: str) -> str:
    return f"(({x}) % {_SIZE}::UHUGEINT)::UBIGINT"


def _times(a: str, by: int, plus: int = 0) -> str:
    return _wrap(f"{_wide(a)} * {by}::UHUGEINT + {plus}::UHUGEINT")


def _turned(x: str, bits: int) -> str:
    return _wrap(f"{_wide(x)} * {1 << bits}::UHUGEINT + {_wide(f'({x}) >> {64 - bits}')}")


def _round(acc: str, lane: str) -> str:
    return _times(_turned(_wrap(f"{_wide(acc)} + {_wide(lane)} * {P2}::UHUGEINT"), 31), P1)


def _lane(at: str, size: int) -> str:
    """The little-endian number of size bytes at a byte position of the hexadecimal text x."""
    pairs = " || ".join(f"substr(x, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(size)))
    return f"CAST('0x' || {pairs} AS UBIGINT)"


def _fold(start: str, count: str, at: str, size: int, step: str) -> str:
    """start folded with the lanes of size bytes from at on; step speaks of acc and lane."""
    return f"list_reduce(list_concat([{start}], list_transform(range({count}), lambda i: {_lane(at, size)})), lambda acc, lane: {step})"


def xxh64_tables(source: str, seed: int = 42) -> str:
    """Common table expressions up to `hashed`: the columns of source, which has a text column s, and its hash h (UBIGINT)."""
    starts = [(seed + P1 + P2) % _SIZE, (seed + P2) % _SIZE, seed, (seed - P1) % _SIZE]
    lanes = ", ".join(f"{_fold(f'{v}::UBIGINT', 'n // 32', f'32 * i + {8 * k}', 8, _round('acc', 'lane'))} AS v{k}" for k, v in enumerate(starts))
    merged = "m"
    text = f"""xx_bytes AS (SELECT *, hex(encode(s)) AS x, CAST(octet_length(encode(s)) AS BIGINT) AS n FROM {source}),
        xx_lanes AS (SELECT *, {lanes} FROM xx_bytes),
        xx_merge0 AS (SELECT *, {_wrap(" + ".join(_wide(_turned(f"v{k}", r)) for k, r in enumerate((1, 7, 12, 18))))} AS {merged} FROM xx_lanes)"""
    for k in range(4):
        text += f""",
        xx_merge{k + 1} AS (SELECT * REPLACE ({_times(f"xor(m, {_round('0::UBIGINT', f'v{k}')})", P1, P4)} AS m) FROM xx_merge{k})"""
    begun = f"CASE WHEN n >= 32 THEN {_wrap(_wide('m') + ' + ' + _wide('n'))} ELSE {_wrap(f'{seed + P5}::UHUGEINT + ' + _wide('n'))} END"
    text += f""",
        xx_begun AS (SELECT * REPLACE ({begun} AS m) FROM xx_merge4),
        xx_eights AS (SELECT * REPLACE ({_fold("m", "(n % 32) // 8", "n // 32 * 32 + 8 * i", 8, _times(_turned(f"xor(acc, {_round('0::UBIGINT', 'lane')})", 27), P1, P4))} AS m) FROM xx_begun),
        xx_fours AS (SELECT * REPLACE ({_fold("m", "(n % 8) // 4", "n // 8 * 8", 4, _times(_turned(f"xor(acc, {_times('lane', P1)})", 23), P2, P3))} AS m) FROM xx_eights),
        xx_ones AS (SELECT * REPLACE ({_fold("m", "n % 4", "n // 4 * 4 + i", 1, _times(_turned(f"xor(acc, {_times('lane', P5)})", 11), P1))} AS m) FROM xx_fours),
        xx_mixed AS (SELECT * REPLACE ({_times("xor(m, m >> 33)", P2)} AS m) FROM xx_ones),
        xx_again AS (SELECT * REPLACE ({_times("xor(m, m >> 29)", P3)} AS m) FROM xx_mixed),
        hashed AS (SELECT * EXCLUDE (x, n, v0, v1, v2, v3, m), xor(m, m >> 32) AS h FROM xx_again)"""
    return text
