"""Seeded draws as plain integer SQL.

``rand(seed)`` changes with the partitioning and cannot be repeated by another
engine.  Every draw here is a function of (seed, scope, salt, row key) made of
xor, multiply and shift on BIGINT, so it stays inside whole-stage codegen, costs
a few nanoseconds, survives task retries and can be checked value by value.

One round is ``((x xor word) * odd) >> 15`` cut to 32 bits.  The key words are
absorbed one round each and two more rounds finish the draw.  Each step names
its input once, so the expression grows linearly with the number of rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F, types as T

MASK = 0xFFFFFFFF
ABSORB = (0x7FEB352D, 0x6C62272D)
FINISH = ((0x1B873593, 0x5BD1E995), (0x27D4EB2D, 0x7FEB352D))

KEY_PREFIX = "__key_"


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def salt_words(seed: int, *salt: object) -> tuple[int, int]:
    digest = hashlib.md5("|".join(str(s) for s in (seed, *salt)).encode()).hexdigest()
    return int(digest[:8], 16), int(digest[8:16], 16)


def draw_sql(keys: Sequence[str], salt: tuple[int, int]) -> str:
    """A uniform 32-bit integer for the row named by the BIGINT expressions ``keys``."""
    words = []
    for key in keys:
        words += [f"({key} & {MASK}L)", f"(shiftright({key}, 32) & {MASK}L)"]
    x = f"{salt[0]}L"
    for i, word in enumerate(words):
        mixed = f"{x} ^ {word}" + (f" ^ {salt[1]}L" if i == 1 else "")
        x = f"(shiftright(({mixed}) * {ABSORB[i % 2]}L, 15) & {MASK}L)"
    for const, odd in FINISH:
        x = f"(shiftright(({x} ^ {const}L) * {odd}L, 15) & {MASK}L)"
    return x


@dataclass(frozen=True)
class Dice:
    """Draws for the rows named by ``keys``; all methods return SQL text."""

    keys: tuple[str, ...]
    seed: int = 42
    scope: str = ""
    hidden: tuple[str, ...] = field(default=(), compare=False)

    def draw(self, *salt: object) -> str:
        return draw_sql(self.keys, salt_words(self.seed, self.scope, *salt))

    def pick(self, n: int | str, *salt: object) -> str:
        """Uniform integer in [0, n); ``n`` is a number or an expression below 2**31."""
        if isinstance(n, int) and n > 1 << 31:
            return self.wide_pick(str(n), *salt)
        size = f"{n}L" if isinstance(n, int) else f"({n})"
        return f"shiftright({self.draw(*salt)} * {size}, 32)"

    def wide_pick(self, n: str, *salt: object) -> str:
        """Uniform integer in [0, n) from 52 bits, for sizes that may pass 2**31."""
        high, low = self.draw(*salt, "high"), self.draw(*salt, "low")
        bits = f"({high} * 1048576L + shiftright({low}, 12))"
        return f"CAST(floor(({bits} / 4503599627370496D) * ({n})) AS BIGINT)"

    def unit(self, *salt: object) -> str:
        return f"({self.draw(*salt)} / 4294967296D)"

    def chance(self, p: float, *salt: object) -> str:
        """True with probability ``p`` (exact to 2**-32)."""
        return f"({self.draw(*salt)} < {round(min(max(p, 0.0), 1.0) * (1 << 32))}L)"


def text_key(column: str) -> str:
    """BIGINT name of a text value: the first 60 bits of its MD5."""
    return f"CAST(conv(substr(md5({column}), 1, 15), 16, 10) AS BIGINT)"


def ntz_micros(value: str) -> str:
    """Epoch microseconds of a TIMESTAMP_NTZ read as UTC, whatever the session time zone."""
    since = f"({value} - TIMESTAMP_NTZ '1970-01-01 00:00:00')"
    return f"CAST(CAST(CAST({since} AS INTERVAL SECOND) AS DECIMAL(18, 6)) * 1000000 AS BIGINT)"


def roll(df: DataFrame, key: Sequence[str] | str, seed: int = 42,
         scope: str = "") -> tuple[DataFrame, Dice]:
    """Dice for the rows of ``df``, named by the unique key columns ``key``.

    Integer keys are used in place.  Other types get one hidden BIGINT column,
    so that their hash is computed once per row; :func:`unroll` drops it.
    """
    names = [key] if isinstance(key, str) else list(key)
    exprs, hidden = [], []
    for name in names:
        kind, ref = df.schema[name].dataType, quote(name)
        if isinstance(kind, T.IntegralType):
            exprs.append(f"coalesce(CAST({ref} AS BIGINT), -1L)")
            continue
        if isinstance(kind, T.DateType):
            value = f"CAST(unix_date({ref}) AS BIGINT)"
        elif isinstance(kind, T.TimestampNTZType):
            value = ntz_micros(ref)
        elif isinstance(kind, T.TimestampType):
            value = f"unix_micros({ref})"
        else:
            value = text_key(f"CAST({ref} AS STRING)")
        hidden_name = KEY_PREFIX + name
        df = df.withColumn(hidden_name, F.expr(f"coalesce({value}, -1L)"))
        hidden.append(hidden_name)
        exprs.append(quote(hidden_name))
    return df, Dice(tuple(exprs), seed, scope, tuple(hidden))


def unroll(df: DataFrame, dice: Dice) -> DataFrame:
    return df.drop(*dice.hidden) if dice.hidden else df


def uuid_sql(dice: Dice, *salt: object) -> str:
    """Version-4 shaped uuid from the MD5 of (seed, scope, salt, key); unique per key."""
    head = "|".join(str(s) for s in (dice.seed, dice.scope, *salt)).replace("'", "")
    md5 = f"md5(concat_ws('|', '{head}', {', '.join(dice.keys)}))"
    return (f"concat(substr({md5}, 1, 8), '-', substr({md5}, 9, 4), '-4', substr({md5}, 14, 3), "
            f"'-a', substr({md5}, 18, 3), '-', substr({md5}, 21, 12))")
