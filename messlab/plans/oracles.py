"""The catalogue once more as single SQL statements for an independent engine.

The draws are spelled out in that engine's own operators; only seeds, word
lists and sample specifications are shared with the Spark side.
"""

from __future__ import annotations

import math

from messlab.functions import words
from messlab.functions.rng import ABSORB, FINISH, salt_words
from messlab.operators.shape import column_orders
from messlab.plans import samples

M = 4294967295


class Draw:
    """Seeded draws on BIGINT key expressions within a scope."""

    def __init__(self, scope: str, *keys: str):
        self.scope, self.keys = scope, keys

    def bits(self, *salt) -> str:
        first, second = salt_words(42, self.scope, *salt)
        parts = [p for k in self.keys for p in (f"(({k})::BIGINT & {M})", f"((({k})::BIGINT >> 32) & {M})")]
        x = f"{first}::BIGINT"
        for i, part in enumerate(parts):
            x = f"xor({x}, {part})"
            if i == 1:
                x = f"xor({x}, {second}::BIGINT)"
            x = f"((({x} * {ABSORB[i % 2]}) >> 15) & {M})"
        for const, odd in FINISH:
            x = f"(((xor({x}, {const}::BIGINT) * {odd}) >> 15) & {M})"
        return x

    def pick(self, n, *salt) -> str:
        return f"(({self.bits(*salt)} * ({n})) >> 32)"

    def wide(self, n, *salt) -> str:
        bits = f"({self.bits(*salt, 'high')} * 1048576 + ({self.bits(*salt, 'low')} >> 12))"
        return f"floor(({bits} / 4503599627370496::DOUBLE) * ({n}))::BIGINT"

    def hit(self, p, *salt) -> str:
        return f"({self.bits(*salt)} < {round(p * 4294967296)})"

    def uuid(self, *salt) -> str:
        head = "|".join(str(s) for s in (42, self.scope, *salt))
        digest = f"md5(concat_ws('|', '{head}', {', '.join(f'({k})::VARCHAR' for k in self.keys)}))"
        return (f"(substr({digest}, 1, 8) || '-' || substr({digest}, 9, 4) || '-4' || substr({digest}, 14, 3) "
                f"|| '-a' || substr({digest}, 18, 3) || '-' || substr({digest}, 21, 12))")

    def word(self, options, *salt) -> str:
        return choose(options, self.pick(len(options), *salt))


def choose(options, ix: str) -> str:
    values = ", ".join(str(o) if isinstance(o, int) else "'" + o.replace("'", "''") + "'" for o in options)
    return f"([{values}])[1 + {ix}]"


def stamp(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S.%f')"


def text_key(value: str) -> str:
    return f"(('0x' || substr(md5({value}), 1, 15))::BIGINT)"


ORACLES: dict[str, str] = {}
ORDERS = Draw("orders", "o_orderkey")
EVENTS = Draw("events", "event_id")
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINES = Draw("lineitem", *LINE_KEY)


def half(bits: str, odd: bool) -> str:
    return f"({bits} >> 16)" if odd else f"({bits} & 65535)"


# ------------------------------------------------------------ keys and joins

POOL = Draw("key pool", "key").bits("order")


def pool(keys: str, cap: str = "") -> str:
    return (f"SELECT row_number() OVER (ORDER BY {POOL}, key) - 1 AS ix, key FROM ({keys})"
            + (f" QUALIFY ix < {cap}" if cap else ""))


ORACLES["fk_sample_orphans"] = f"""
WITH pool AS ({pool("SELECT DISTINCT c_custkey AS key FROM customer WHERE c_custkey IS NOT NULL")}),
child AS (SELECT o_orderkey, {ORDERS.hit(0.05, 'customer_key', 'orphan')} AS lost,
  {ORDERS.pick('(SELECT count(*) FROM pool)', 'customer_key', 'parent')} AS pick,
  {ORDERS.uuid('customer_key')} AS fresh FROM orders)
SELECT o_orderkey, CASE WHEN lost THEN fresh ELSE key::VARCHAR END AS customer_key, lost AS orphan
FROM child JOIN pool ON pick = ix"""

ORACLES["orphan_rows"] = f"""
SELECT o_orderkey, {ORDERS.uuid('customer_key')} AS customer_key FROM orders
WHERE {ORDERS.hit(0.05, 'customer_key', 'orphan')}"""
ORACLES["orphan_audit"] = f"""
SELECT count(*) AS rows, 0 AS null_keys, count(*) FILTER (WHERE {ORDERS.hit(0.05, 'customer_key', 'orphan')}) AS orphans,
  orphans / count(*) AS rate FROM orders"""

ORACLES["key_pool_topk"] = pool("SELECT DISTINCT c_custkey AS key FROM customer", "1000")

CUSTOMERS = Draw("customer", "c_custkey")


def repeated(table: str, key: str, pk: str, pct: float, scope: str, rest: str) -> str:
    """Rows of a table whose pk was overwritten for a share of rows, as a SELECT."""
    targets, sources = (Draw(f"{scope}|{s}", key).bits("order") for s in ("targets", "sources"))
    return f"""SELECT {rest}, CASE WHEN a.rt < k.k THEN b.{pk} ELSE a.{pk} END AS {pk}
FROM (SELECT *, row_number() OVER (ORDER BY {targets}, {key}) - 1 AS rt FROM {table}) a
JOIN (SELECT {pk}, row_number() OVER (ORDER BY {sources}, {key}) - 1 AS rs FROM {table}) b ON a.rt = b.rs
CROSS JOIN (SELECT greatest(1, floor(count(*) * {pct}::DOUBLE)::BIGINT) AS k FROM {table}) k"""


ORACLES["key_pool_after_faults"] = f"""
WITH dirty AS (SELECT c_custkey, CASE WHEN NOT {CUSTOMERS.hit(0.1, 'key', 'null')} THEN c_custkey END AS key
  FROM customer),
twice AS ({repeated('dirty', 'c_custkey', 'key', 0.2, 'customer', 'a.c_custkey')})
{pool("SELECT DISTINCT key FROM twice WHERE key IS NOT NULL")}"""

ORACLES["fresh_foreign_keys"] = f"SELECT o_orderkey, {ORDERS.uuid('parent')} AS parent FROM orders"
ORACLES["dense_positions"] = "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS ix FROM events"
HASHED = Draw("index", "o_orderkey").bits("order")
ORACLES["hash_positions_by_group"] = f"""
SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {HASHED}, o_orderkey) - 1
  AS ix, count(*) OVER (PARTITION BY o_orderstatus) AS group_size FROM orders"""
ORACLES["sample_without_replacement"] = f"""
SELECT o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (ORDER BY {Draw('sample', 'o_orderkey').bits('order')}, o_orderkey)
  <= greatest(1, floor((SELECT count(*) FROM orders) * 0.1::DOUBLE))"""


# -------------------------------------------------------------- generators

def slots(scope: str, names: list[str], chunk: str) -> str:
    """orders with the pool position of each named column."""
    row = Draw(scope, "o_orderkey")
    size = f"least(5000, least({chunk}, n - (o_orderkey // {chunk}) * {chunk}) + 1)"
    cells = ", ".join(f"(o_orderkey // {chunk}) * 5000 + {row.pick(size, name, 'slot')} AS s_{name}" for name in names)
    return f"SELECT o_orderkey, n, {cells} FROM orders CROSS JOIN (SELECT count(*) AS n FROM orders)"


def permutation(scope: str, name: str, size: int, row: str) -> str:
    first, second = salt_words(42, scope, name, "permutation")
    factor = 1 + first % max(1, min(2**31 - 1, 2**61 // size))
    while math.gcd(factor, size) != 1:
        factor += 1
    return f"(({factor % size} * ({row}) + {second % size}) % {size})"


KEYS = Draw("keys", "o_orderkey")
ORACLES["gen_keys"] = f"""
SELECT o_orderkey, {KEYS.uuid('id')} AS id, 1 + {permutation('keys', 'number', 2_000_000, 'o_orderkey')} AS number,
  {Draw('keys', 's_pooled_id').uuid('pooled_id')} AS pooled_id, {KEYS.uuid('parent_id')} AS parent_id
FROM ({slots('keys', ['pooled_id'], '4000')})"""


def slot_draw(name: str, scope: str = "text") -> Draw:
    return Draw(scope, f"s_{name}")


def letters(draw: Draw, name: str, used: int, alphabet: str, *salt) -> str:
    v = half(draw.bits(name, *salt, "letters", used // 2), used % 2 == 1)
    return f"substr('{alphabet}', 1 + (({v} * {len(alphabet)}) >> 16)::INT, 1)"


def digits(draw: Draw, name: str, token: int, count: int, *salt) -> str:
    return f"lpad({draw.pick(10 ** count, name, *salt, 'digits', token)}::VARCHAR, {count}, '0')"


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ANY = UPPER + "0123456789"
BOTH = UPPER.lower() + UPPER


def text_cells() -> dict[str, str]:
    d = {c["name"]: slot_draw(c["name"]) for c in samples.TEXT_COLUMNS}

    def pick(name, options, *salt):
        return d[name].word(options, name, *salt)

    sentence = [pick("c_text", [w.capitalize() for w in words.SENTENCE_WORDS], "first")]
    more = [choose(words.SENTENCE_WORDS,
                   f"(({half(d['c_text'].bits('c_text', i // 2), i % 2 == 1)} * {len(words.SENTENCE_WORDS)}) >> 16)")
            for i in range(13)]
    length = d["c_text"].pick(9, "c_text", "length")
    low = [[w.lower() for w in names] for names in (words.FIRST_NAMES, words.LAST_NAMES)]
    phone = d["c_phone"]
    product = d["c_product_name"]
    ip = d["c_ipv4"].bits("c_ipv4")
    return {
        "c_name": f"{pick('c_name', words.FIRST_NAMES, 'first')} || ' ' || {pick('c_name', words.LAST_NAMES, 'last')}",
        "c_company": f"{pick('c_company', words.LAST_NAMES, 'last')} || ' ' || "
                     f"{pick('c_company', words.COMPANY_SUFFIXES, 'suffix')}",
        "c_email": f"{pick('c_email', low[0], 'first')} || '.' || {pick('c_email', low[1], 'last')} || "
                   f"{d['c_email'].pick(100, 'c_email', 'number')} || '@' || "
                   f"{pick('c_email', words.MAIL_DOMAINS, 'domain')}",
        "c_phone": f"{digits(phone, 'c_phone', 0, 3)} || '-' || {digits(phone, 'c_phone', 2, 3)} || '-' || "
                   f"{digits(phone, 'c_phone', 4, 4)}",
        "c_address": f"(1 + {d['c_address'].pick(9999, 'c_address', 'number')}) || ' ' || "
                     f"{pick('c_address', words.STREETS, 'street')} || ', ' || "
                     f"{pick('c_address', words.CITIES, 'city')} || ', ' || "
                     f"{pick('c_address', words.STATES, 'state')} || ' ' || "
                     f"{digits(d['c_address'], 'c_address', 0, 5, 'zip')}",
        "c_job_title": pick("c_job_title", words.JOBS), "c_state": pick("c_state", words.STATES),
        "c_ipv4": f"({ip} >> 24) || '.' || (({ip} >> 16) & 255) || '.' || (({ip} >> 8) & 255) || '.' || ({ip} & 255)",
        "c_country": pick("c_country", words.COUNTRIES), "c_city": pick("c_city", words.CITIES),
        "c_text": f"array_to_string([{', '.join(sentence + more)}][1:6 + {length}], ' ') || '.'",
        "c_product_name": f"{pick('c_product_name', words.PRODUCT_ADJECTIVES, 'adjective')} || ' ' || "
                          f"{pick('c_product_name', words.PRODUCT_NOUNS, 'noun')} || ' ' || "
                          f"{letters(product, 'c_product_name', 0, BOTH, 'code')} || "
                          f"{letters(product, 'c_product_name', 1, BOTH, 'code')} || '-' || "
                          f"{digits(product, 'c_product_name', 3, 3, 'code')}",
    }


def cells(expressions: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in expressions.items())


ORACLES["gen_text_columns"] = (f"SELECT o_orderkey, {cells(text_cells())} FROM "
                               f"({slots('text', [c['name'] for c in samples.TEXT_COLUMNS], '4000')})")


def pattern_cells() -> dict[str, str]:
    free, code, track = (slot_draw(n, "patterns") for n in ("plain_text", "bin_code", "tracking"))
    return {
        "plain_text": " || ".join(letters(free, "plain_text", i, UPPER) for i in range(8)),
        "bin_code": f"'WH-' || {letters(code, 'bin_code', 0, UPPER)} || {letters(code, 'bin_code', 1, UPPER)} || '-' "
                    f"|| {digits(code, 'bin_code', 4, 3)}",
        "tracking": "'1Z' || " + " || ".join(letters(track, "tracking", i, ANY) for i in range(12)),
    }


ORACLES["gen_patterns"] = (f"SELECT o_orderkey, {cells(pattern_cells())} FROM "
                           f"({slots('patterns', [c['name'] for c in samples.PATTERN_COLUMNS], 'n')})")

SCALARS = Draw("scalars", "o_orderkey")


def rounded(draw: Draw, name: str, low: float, high: float, places: int) -> str:
    unit = f"({draw.bits(name)} / 4294967296::DOUBLE)"
    scale = f"{10 ** places}::DOUBLE"
    return f"floor(({low}::DOUBLE + {unit} * {high - low}::DOUBLE) * {scale} + 0.5::DOUBLE) / {scale}"


ORACLES["gen_scalars"] = "SELECT o_orderkey, " + cells({
    "flag": SCALARS.hit(0.5, "flag"),
    "status": SCALARS.word(["new", "paid", "sent", "it's back"], "status"),
    "level": SCALARS.word([10, 20, 30], "level"), "no_choice": "'unknown'",
    '"count"': SCALARS.pick(1001, "count"), "score": f"-50 + {SCALARS.pick(101, 'score')}",
    "amount": rounded(SCALARS, "amount", 0.0, 1000.0, 2), "ratio": rounded(SCALARS, "ratio", -1.0, 1.0, 4),
    "strange": "NULL::VARCHAR"}) + " FROM orders"

START, END = "epoch(TIMESTAMP '2023-01-01')::BIGINT", "epoch(TIMESTAMP '2024-01-01')::BIGINT"
YEAR = 365 * 86400


def moment(draw: Draw, name: str, late: float = 0.0) -> str:
    seconds = f"({START} + {draw.pick(YEAR, name)})"
    if late:
        seconds = (f"({seconds} - CASE WHEN {draw.hit(late, name, 'late')} "
                   f"THEN {draw.pick(864000, name, 'late by')} ELSE 0 END)")
    return f"make_timestamp(least(greatest({seconds}, {START}), {END}) * 1000000)"


TIMES = Draw("times", "event_id")
ORACLES["gen_times"] = f"""
SELECT event_id, {stamp(moment(TIMES, 'at', 0.1))} AS at, {moment(TIMES, 'on_day', 0.1)}::DATE::VARCHAR AS on_day
FROM events"""
GROWTH = Draw("growth", "event_id")
LARGEST = ", ".join(GROWTH.bits("at", "growth", i) for i in range(5))
GROWN = (f"({START} + 864000) * 1000000 + floor((greatest({LARGEST}) / 4294967296::DOUBLE) "
         f"* ({YEAR - 864000} * 1000000::DOUBLE))::BIGINT")
ORACLES["gen_times_growth"] = f"SELECT event_id, {stamp(f'make_timestamp({GROWN})')} AS at FROM events"
ORACLES["gen_times_past_end"] = "SELECT event_id, '2024-01-01 00:00:00.000000' AS at FROM events"
DATES = Draw("dates", "event_id")
ORACLES["gen_date_strings"] = "SELECT event_id, " + cells({
    c["name"]: f"strftime({moment(DATES, c['name'])}, '{c.get('format', '%Y-%m-%d')}')"
    for c in samples.DATE_TEXT_COLUMNS}) + " FROM events"


# ------------------------------------------------------------------- faults

def nulled(draw: Draw, name: str, p: float, value: str | None = None) -> str:
    return f"CASE WHEN NOT {draw.hit(p, name, 'null')} THEN {value or name} END"


NULLED = f"""SELECT o_orderkey, {nulled(ORDERS, 'o_custkey', 0.1)} AS o_custkey, o_orderstatus, o_totalprice,
  {nulled(ORDERS, 'o_orderdate', 0.1)} AS o_orderdate, {nulled(ORDERS, 'o_orderpriority', 0.1)} AS o_orderpriority
  FROM orders"""
ORACLES["inject_nulls"] = f"SELECT * REPLACE ({stamp('o_orderdate')} AS o_orderdate) FROM ({NULLED})"
ORDER_NAMES = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def long_form(table: str, counts: dict[str, dict[str, str]], rate: str | None = None) -> str:
    """(column, rows, counters...) one SELECT per column, united."""
    lines = []
    for column, conditions in counts.items():
        numbers = ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in conditions.items())
        lines.append(f"SELECT '{column}' AS \"column\", count(*) AS rows, {numbers}"
                     + (f", {rate} / count(*) AS rate" if rate else "") + f" FROM ({table})")
    return "\nUNION ALL ".join(lines)


ORACLES["null_profile"] = long_form(NULLED, {c: {"nulls": f"{c} IS NULL"} for c in ORDER_NAMES}, "nulls")
REPEATED = repeated("orders", "o_orderkey", "o_orderkey", 0.02, "orders",
                    "a.o_custkey, a.o_orderstatus, a.o_totalprice, a.o_orderdate, a.o_orderpriority")
ORACLES["inject_duplicate_keys"] = f"SELECT * REPLACE ({stamp('o_orderdate')} AS o_orderdate) FROM ({REPEATED})"
ORACLES["duplicate_key_audit"] = f"""
SELECT sum(n)::BIGINT AS rows, 0 AS null_keys, count(*) AS distinct_keys, count(*) FILTER (WHERE n > 1)
  AS repeated_keys, (sum(n) - count(*))::BIGINT AS surplus_rows, (sum(n) - count(*))::DOUBLE / sum(n)::DOUBLE AS rate
FROM (SELECT o_orderkey, count(*) AS n FROM ({REPEATED}) GROUP BY 1)"""
ORACLES["duplicate_key_rows"] = """
SELECT l_orderkey AS key, count(*) AS rows FROM lineitem GROUP BY 1 HAVING count(*) > 1"""

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
NEGATED = "SELECT * REPLACE (" + ", ".join(
    f"CASE WHEN {LINES.hit(0.02, c, 'negative')} THEN -abs({c}) ELSE {c} END AS {c}" for c in NUMBERS
) + ") FROM lineitem"
ORACLES["inject_negatives"] = f"SELECT * REPLACE ({stamp('l_shipdate')} AS l_shipdate) FROM ({NEGATED})"
ORACLES["negative_audit"] = long_form(
    NEGATED, {c: {"negatives": f"{c} < 0"} for c in [*LINE_KEY[:1], "l_partkey", "l_suppkey", "l_linenumber", *NUMBERS]},
    "negatives")


def misdated(draw: Draw, name: str, p: float, value: str, kind: str) -> str:
    return (f"CASE WHEN NOT {draw.hit(p, name, 'impossible')} THEN {value} WHEN {draw.hit(0.5, name, 'future')} "
            f"THEN {kind} '2099-12-31' ELSE {kind} '1900-01-01' END")


MISDATED = f"""SELECT * REPLACE ({misdated(ORDERS, 'o_orderdate', 0.05, 'o_orderdate', 'TIMESTAMP')} AS o_orderdate),
  {misdated(ORDERS, 'date_text', 0.05, "strftime(o_orderdate, '%d/%m/%Y')", '')} AS date_text FROM orders"""
ORACLES["inject_impossible_dates"] = f"""
SELECT o_orderkey, {stamp('o_orderdate')} AS o_orderdate, date_text FROM ({MISDATED})"""
AS_TIME = {"o_orderdate": "o_orderdate", "date_text": "try_cast(date_text AS TIMESTAMP)"}
ORACLES["date_audit"] = long_form(MISDATED, {c: {
    "far_future": f"{t} = TIMESTAMP '2099-12-31'", "far_past": f"{t} = TIMESTAMP '1900-01-01'",
    "outside": f"{t} < TIMESTAMP '1996-01-01' OR {t} > TIMESTAMP '2000-12-31'"} for c, t in AS_TIME.items()})
ORACLES["date_text_audit"] = long_form(
    MISDATED, {"date_text": {"malformed": "NOT regexp_full_match(date_text, '[0-9]{4}-[0-9]{2}-[0-9]{2}')"}})


def gated(name: str, start: str) -> str:
    return f"CASE WHEN o_orderdate IS NULL OR o_orderdate >= TIMESTAMP '{start}' THEN {name} END AS {name}"


GATED = f"""SELECT * REPLACE ({gated('o_orderpriority', '1997-01-01')}, {gated('o_orderstatus', '1999-06-01')})"""
ORACLES["schema_version_gate"] = f"""
SELECT * REPLACE ({stamp('o_orderdate')} AS o_orderdate) FROM ({GATED} FROM ({MISDATED}))"""
ORACLES["schema_version_audit"] = "\nUNION ALL ".join(
    f"""SELECT '{start}.{name}' AS "column", count(*) AS rows, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '{start}'
  AND {name} IS NOT NULL) AS early_before, 0::BIGINT AS early_after FROM ({MISDATED})"""
    for name, start in (("o_orderpriority", "1997-01-01"), ("o_orderstatus", "1999-06-01")))


def all_faults() -> str:
    d = Draw("mess", "id")
    keyed = "SELECT o_orderkey AS id, * FROM orders"
    nulls = f"""SELECT * REPLACE ({', '.join(f"{nulled(d, c, 0.1)} AS {c}"
                for c in ('o_custkey', 'o_totalprice', 'o_orderdate'))}) FROM ({keyed})"""
    twice = repeated("nulled", "id", "o_orderkey", 0.03, "mess",
                     "a.id, a.o_custkey, a.o_orderstatus, a.o_totalprice, a.o_orderdate, a.o_orderpriority")
    negative = ", ".join(f"CASE WHEN {d.hit(0.04, c, 'negative')} THEN -abs({c}) ELSE {c} END AS {c}"
                         for c in ("o_custkey", "o_totalprice"))
    dates = f"{misdated(d, 'o_orderdate', 0.05, 'o_orderdate', 'TIMESTAMP')} AS o_orderdate"
    return f"""WITH nulled AS ({nulls}), twice AS ({twice}),
dated AS (SELECT * REPLACE ({negative}, {dates}) FROM twice), gated AS ({GATED} FROM dated)"""


ORACLES["all_faults_in_order"] = f"""{all_faults()}
SELECT * EXCLUDE (id) REPLACE ({stamp('o_orderdate')} AS o_orderdate) FROM gated"""
RULES = {
    ("not null", "o_orderkey"): "o_orderkey IS NULL", ("not null", "o_custkey"): "o_custkey IS NULL",
    ("range", "o_totalprice"): "o_totalprice < 1000 OR o_totalprice > 400000",
    ("choices", "o_orderstatus"): "o_orderstatus NOT IN ('F', 'O')",
    ("not null", "o_orderdate"): "o_orderdate IS NULL",
    ("window", "o_orderdate"): "o_orderdate < TIMESTAMP '1996-01-01' OR o_orderdate > TIMESTAMP '2000-12-31'",
    ("pattern", "o_orderpriority"): "NOT regexp_full_match(o_orderpriority, '[0-9]-[A-Z]{6}')",
    ("missing column", "o_clerk"): "true",
    ("foreign key", "o_custkey"): "o_custkey NOT IN (SELECT c_custkey FROM customer)",
}
ORACLES["conformance"] = all_faults() + "\n" + "\nUNION ALL ".join(
    f"SELECT '{rule}' AS rule, '{c}' AS \"column\", count(*) AS rows, count(*) FILTER (WHERE {condition}) AS violations "
    "FROM gated" for (rule, c), condition in RULES.items()) + """
UNION ALL SELECT 'unique key', 'o_orderkey', count(*), count(*) - count(DISTINCT o_orderkey) FROM gated
UNION ALL SELECT 'row count', '', count(*), abs(count(*) - 10000) FROM gated"""

LATE = f"""SELECT event_id, event_type, least(greatest(CASE WHEN {EVENTS.hit(0.1, 'ts', 'late')} THEN ts
  - to_seconds({EVENTS.pick(864000, 'ts', 'late by')}) ELSE ts END, TIMESTAMP '2024-01-01'), TIMESTAMP '2024-01-31')
  AS ts FROM events"""
ORACLES["late_arrivals"] = f"SELECT * REPLACE ({stamp('ts')} AS ts) FROM ({LATE})"
EARLIER = "max(ts) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
ORACLES["late_rows_daily"] = f"""
SELECT ts::DATE::VARCHAR AS day, count(*) AS rows, count(*) FILTER (WHERE seen - INTERVAL 48 HOUR
  >= date_trunc('day', ts) + INTERVAL 1 DAY) AS late_rows
FROM (SELECT *, {EARLIER} AS seen FROM ({LATE})) GROUP BY 1"""
ORACLES["clip_to_window"] = f"""
SELECT event_id, {stamp("least(greatest(ts, TIMESTAMP '2024-01-05'), TIMESTAMP '2024-01-20')")} AS ts,
  least(greatest(value, 2.0::DOUBLE), 10.0::DOUBLE) AS value FROM events"""
HOURS = {c: f"to_hours((1 + {EVENTS.pick(71, c, 'stale hours')})::INT)" for c in ("ts", "day_text")}
STALE = f"""SELECT event_id, event_type, CASE WHEN {EVENTS.hit(0.05, 'ts', 'stale')} THEN ts - {HOURS['ts']} ELSE ts END
  AS ts, CASE WHEN {EVENTS.hit(0.05, 'day_text', 'stale')}
  THEN strftime(date_trunc('day', ts) - {HOURS['day_text']}, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d') END
  AS day_text FROM events"""
ORACLES["stale_watermark"] = f"SELECT * REPLACE ({stamp('ts')} AS ts) FROM ({STALE})"
ORACLES["stale_audit"] = f"""
SELECT event_type, count(*) AS rows, count(*) FILTER (WHERE ts < seen - INTERVAL 24 HOUR) AS stale_rows
FROM (SELECT *, {EARLIER} AS seen FROM ({STALE})) GROUP BY 1"""
ORACLES["stale_audit_by_user"] = f"""
SELECT user_id, count(*) AS rows, count(*) FILTER (WHERE ts < seen - INTERVAL 24 HOUR) AS stale_rows
FROM (SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM (SELECT user_id, event_id, CASE WHEN {EVENTS.hit(0.05, 'ts', 'stale')} THEN ts - {HOURS['ts']} ELSE ts END AS ts
    FROM events)) GROUP BY 1"""
ORACLES["soft_delete"] = f"SELECT event_id, {EVENTS.hit(0.05, 'soft delete')} AS is_deleted FROM events"
ORACLES["soft_delete_audit"] = f"""
SELECT count(*) AS rows, count(*) FILTER (WHERE {EVENTS.hit(0.05, 'soft delete')}) AS deleted,
  deleted / count(*) AS rate FROM events"""


# -------------------------------------------------------------------- pages

def paged(order: str, size: int = 100, columns: str = "event_id") -> str:
    return (f"SELECT {columns}, row_number() OVER (ORDER BY {order}) - 1 AS ix, count(*) OVER () AS total_records, "
            f"ix // {size} + 1 AS page, (total_records + {size - 1}) // {size} AS total_pages FROM events")


def page_lines(order: str) -> str:
    return f"""SELECT 'events' AS api, page, 100 AS page_size, max(total_pages) AS total_pages, max(total_records)
  AS total_records, string_agg(event_id::VARCHAR, ',' ORDER BY ix) AS event_ids FROM ({paged(order)}) GROUP BY page"""


ORACLES["paginate"] = paged("event_id")
ORACLES["page_envelope"] = page_lines("event_id")
ORACLES["page_roundtrip"] = """
SELECT row_number() OVER (ORDER BY event_id) - 1 AS ix, event_id, user_id, event_type, value FROM events"""
ORACLES["page_browse"] = f"SELECT * FROM ({page_lines('event_id')}) WHERE page = 3"
ORACLES["repaginate_append"] = page_lines("ts >= TIMESTAMP '2024-01-20', event_id")
ORACLES["browse_blocks"] = ORACLES["page_browse"]
ORACLES["repaginate_append_blocks"] = ORACLES["repaginate_append"]
ORACLES["page_counts"] = """
SELECT count(*) AS total_records, greatest(1, (count(*) + 76) // 77) AS total_pages FROM events"""
ORACLES["page_manifest"] = """
SELECT 'events' AS name, (count(*) + 99) // 100 AS pages, count(*) AS records FROM events"""

# -------------------------------------------------------------- file shapes

MONTH = "date_trunc('month', o_orderdate)::DATE"
CENTS = "floor(o_totalprice * 100 + 0.5)::BIGINT"
ORACLES["summary_row"] = f"""
SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey, o_orderstatus, {CENTS} AS cents FROM orders
UNION ALL SELECT 'Total', sum(o_custkey)::BIGINT, NULL, sum({CENTS})::BIGINT FROM orders HAVING count(*) > 0"""
ORACLES["summary_row_per_file"] = f"""
SELECT 'Total' AS o_orderkey, sum({CENTS})::BIGINT AS cents, {MONTH}::VARCHAR AS file_date FROM orders GROUP BY 3"""
ORACLES["sheet_split"] = """
SELECT o_orderkey, CASE WHEN n <= 2 THEN 'Sheet1' WHEN ix < n // 2 THEN 'Sheet1_1' ELSE 'Sheet1_2' END AS sheet
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ix, count(*) OVER () AS n FROM orders)"""

ORDER_FILE = Draw("orders|file", f"({MONTH} - DATE '1970-01-01')")
VARIANT = (f"CASE WHEN {ORDER_FILE.hit(0.3, 'order')} THEN 1 + {ORDER_FILE.pick(4, 'which order')} ELSE 0 END::INT")
FIELD = {c: f"{c}::VARCHAR" for c in ORDER_NAMES}
FIELD["o_totalprice"] = "o_totalprice::DECIMAL(18,2)::VARCHAR"
FIELD["o_orderdate"] = "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"
SHUFFLES = column_orders(ORDER_NAMES)
ORACLES["csv_lines_drift"] = f"""
SELECT o_orderkey, {MONTH}::VARCHAR AS file_date, {VARIANT} AS order_variant, CASE {VARIANT} """ + " ".join(
    f"WHEN {i} THEN " + " || ',' || ".join(FIELD[c] for c in order) for i, order in enumerate(SHUFFLES)
) + " END AS line FROM orders"

WHICH = f"CASE WHEN {ORDER_FILE.hit(0.5, 'mixed dates')} THEN {ORDER_FILE.pick(2, 'which date')} END"
FORMAT = ORDER_FILE.pick(3, "date format")


def mixed(value: str, at: int) -> str:
    formats = " ".join(f"WHEN {i} THEN strftime({value}, '{f}')" for i, f in enumerate(
        ["%d/%m/%Y", "%m-%d-%Y", "%Y%m%d"]))
    return f"CASE WHEN {WHICH} = {at} THEN CASE {FORMAT} {formats} END ELSE strftime({value}, '%Y-%m-%d %H:%M:%S') END"


ORACLES["mixed_date_formats"] = f"""
SELECT o_orderkey, {MONTH}::VARCHAR AS file_date, {mixed('o_orderdate', 0)} AS o_orderdate,
  {mixed('(o_orderdate + INTERVAL 36 HOUR)', 1)} AS due FROM orders"""
ORACLES["missing_header"] = f"""
SELECT DISTINCT {MONTH}::VARCHAR AS file_date, NOT {ORDER_FILE.hit(0.3, 'header')} AS has_header,
  CASE WHEN has_header THEN {VARIANT} = 0 END AS in_order FROM orders"""
APPENDED = f"""
SELECT o_orderkey, {nulled(ORDERS, 'o_custkey', 0.1)} AS o_custkey, o_orderstatus,
  o_totalprice::DECIMAL(18,2)::DOUBLE AS o_totalprice, {stamp('o_orderdate')} AS o_orderdate,
  {nulled(ORDERS, 'o_orderpriority', 0.1)} AS o_orderpriority"""
ORACLES["csv_append"] = f"{APPENDED}, {MONTH}::VARCHAR AS file_date FROM orders"
ORACLES["json_append"] = f"{APPENDED} FROM orders"

SHIP_MONTH = "date_trunc('month', l_shipdate)::DATE"
SHIP_FILE = Draw("lineitem|file", f"({SHIP_MONTH} - DATE '1970-01-01')")
SHIP_OPTIONS = ["l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag"]
DROPPED = (f"CASE WHEN {SHIP_FILE.hit(0.2, 'schema evolution')} THEN "
           f"{choose(SHIP_OPTIONS, SHIP_FILE.pick(5, 'which column'))} END")
ORACLES["schema_evolution_roundtrip"] = f"""
SELECT file_date, l_orderkey, {', '.join(f"CASE WHEN dropped IS NULL OR dropped <> '{c}' THEN {c} END AS {c}"
                                         for c in SHIP_OPTIONS)}
FROM (SELECT *, {SHIP_MONTH}::VARCHAR AS file_date, {DROPPED} AS dropped FROM lineitem)"""

RECORD_NAMES = ["event_id", "event_type", "user_id", "cents", "props"]
RECORD_NULLS = f"""SELECT event_id, {nulled(EVENTS, 'event_type', 0.2)} AS event_type,
  {nulled(EVENTS, 'user_id', 0.2)} AS user_id, {nulled(EVENTS, 'cents', 0.2, 'floor(value * 100 + 0.5)::BIGINT')} AS cents,
  {nulled(EVENTS, 'props', 0.2)} AS props, {EVENTS.hit(0.2, 'nested')} AS nested,
  {EVENTS.hit(0.3, 'missing keys')} AS lacking FROM events"""


def pair(name: str) -> str:
    return f"'\"{name}\":' || coalesce(to_json({name})::VARCHAR, 'null')"


def kept(name: str, condition: str = "") -> str:
    return f"CASE WHEN NOT (lacking AND {name} IS NULL){condition} THEN {pair(name)} END"


RECORD = "'{' || concat_ws(',', " + ", ".join(
    [kept(n) for n in RECORD_NAMES[:3]] + [kept(n, " AND NOT nested") for n in RECORD_NAMES[3:]]
) + ", CASE WHEN nested THEN '\"details\":{' || " + " || ',' || ".join(pair(n) for n in RECORD_NAMES[3:]
) + " || '}' END) || '}'"
RECORDS = f"SELECT event_id, {RECORD} AS record FROM ({RECORD_NULLS})"
ORACLES["json_shape_variation"] = RECORDS
ORACLES["json_shape_audit"] = long_form(RECORD_NULLS, {n: {
    "present": f"{n} IS NOT NULL",
    "null_value": f"{n} IS NULL AND (NOT lacking {'OR nested' if n in RECORD_NAMES[3:] else ''})",
    "nested": "nested" if n in RECORD_NAMES[3:] else "false",
    "missing": f"{n} IS NULL AND lacking {'AND NOT nested' if n in RECORD_NAMES[3:] else ''}"} for n in RECORD_NAMES})
EXPECTED = "VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in samples.RECORD_TYPES.items())
ORACLES["schema_audit"] = f"""
WITH seen AS (SELECT k AS "column", CASE json_type(record, '$.' || k) WHEN 'VARCHAR' THEN 'string'
    WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null'
    ELSE 'number' END AS found, count(*) AS rows
  FROM (SELECT record, unnest(json_keys(record)) AS k FROM ({RECORDS})) GROUP BY 1, 2),
want("column", expected) AS ({EXPECTED})
SELECT coalesce(seen."column", want."column") AS "column", expected, found, coalesce(rows, 0) AS rows,
  CASE WHEN found IS NULL THEN 'missing' WHEN expected IS NULL THEN 'extra' WHEN found = 'null' THEN 'null'
  WHEN found <> expected THEN 'type' ELSE 'ok' END AS issue
FROM seen FULL JOIN want ON seen."column" = want."column" """

N_EVENTS = "(SELECT count(*) FROM events)"
FILE_NO = f"event_id // greatest({N_EVENTS} // 20, 1)"
WEEK = "(DATE '2024-01-01' + (7 * file_no)::INT)"
BY_MONTH = "(DATE '2024-01-31' + to_months(file_no::INT))::DATE"


def file_line(frequency: str, day: str, end: str) -> str:
    return f"""SELECT '{frequency}' AS frequency, file_no, ({day})::VARCHAR AS file_date,
  epoch({day})::BIGINT AS file_start, {end} AS file_end,
  'events_' || ({day})::VARCHAR || '_w' || (file_no + 1) || '.csv' AS file_name, count(*) AS rows
FROM (SELECT {FILE_NO} AS file_no FROM events) GROUP BY file_no"""


ORACLES["file_date_sequence"] = f"""
{file_line('weekly', WEEK, f"least(epoch({WEEK})::BIGINT + 86400, epoch(DATE '2024-04-01')::BIGINT)")}
UNION ALL {file_line('monthly', BY_MONTH, f"epoch({BY_MONTH})::BIGINT + 86400")}"""
FILES = Draw("files", "event_id")
ORACLES["file_windows"] = f"""
SELECT event_id, (DATE '2024-01-01' + file_no::INT)::VARCHAR AS file_date,
  {stamp(f"make_timestamp((epoch(DATE '2024-01-01' + file_no::INT)::BIGINT + {FILES.pick(86400, 'at')}) * 1000000)")} AS at
FROM (SELECT event_id, {FILE_NO} AS file_no FROM events)"""
ORACLES["file_manifest"] = f"""
SELECT 'orders' AS entity, 'parquet' AS format, {MONTH}::VARCHAR AS file_date, count(*) AS rows, true AS sized
FROM orders GROUP BY 3"""
ORACLES["table_summary"] = "\nUNION ALL ".join(
    f"SELECT '{t}' AS \"table\", 2 * count(*) AS target_rows, 2 * count(*) AS actual_rows, 0::BIGINT AS missing_rows "
    f"FROM {t}"
    for t in ("region", "nation", "customer", "supplier", "part", "orders"))

# ------------------------------------------------------------------ batches

DAY_POOL = Draw("key pool", "(by_day - DATE '1970-01-01')", "parent").bits("order")


def same_day(child: str, draw: Draw, name: str, orphan: float, parents: str, rest: str) -> str:
    """Child rows with a parent of their own day; ``parents`` selects (by_day, parent)."""
    return f"""
WITH pool AS (SELECT *, row_number() OVER (PARTITION BY by_day ORDER BY {DAY_POOL}, by_day, parent) - 1 AS ix,
  count(*) OVER (PARTITION BY by_day) AS n FROM (SELECT DISTINCT * FROM ({parents}))),
days AS (SELECT by_day, max(n) AS n FROM pool GROUP BY 1),
child AS (SELECT c.*, CASE WHEN n IS NOT NULL AND NOT {draw.hit(orphan, name, 'orphan')}
  THEN {draw.wide('n', name, 'parent')} END AS pick, {draw.uuid(name)} AS fresh
  FROM ({child}) c LEFT JOIN days ON day = by_day)
SELECT {rest}, CASE WHEN pick IS NULL THEN fresh ELSE parent::VARCHAR END AS {name}
FROM child LEFT JOIN pool ON day = by_day AND pick = ix"""


ORACLES["daily_batches"] = same_day(
    f"SELECT {', '.join(LINE_KEY)}, l_shipdate::DATE AS day FROM lineitem", LINES, "order_key", 0.05,
    "SELECT o_orderdate::DATE AS by_day, o_orderkey AS parent FROM orders",
    f"{', '.join(LINE_KEY)}, day::VARCHAR AS day")
PER_DAY = f"greatest({N_EVENTS} // 30, 1)"
DAYS = Draw("days", "event_id")
ORACLES["daily_windows"] = f"""
SELECT event_id, day::VARCHAR AS day, {DAYS.uuid('id')} AS id,
  {stamp(f"make_timestamp((epoch(day)::BIGINT + {DAYS.pick(86400, 'at')}) * 1000000)")} AS at
FROM (SELECT event_id, DATE '2024-01-01' + (event_id // {PER_DAY})::INT AS day FROM events)"""
ORACLES["incremental_append"] = """
SELECT o_orderkey, o_totalprice, CASE WHEN o_orderdate >= TIMESTAMP '1998-01-01' THEN o_orderpriority END AS channel
FROM orders"""
ORACLES["append_rows"] = """
SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier"""
ORACLES["daily_accounting"] = "SELECT l_shipdate::DATE::VARCHAR AS day, count(*) AS rows FROM lineitem GROUP BY 1"


# ----------------------------------------------------------- specifications

CHILD = Draw("children", "row")
KEY_RANGE = 4_000_000_000


def coprime(name: str, size: str, scope: str) -> str:
    """Factor and shift of a permutation of ``size`` positions; the scope is a SQL text."""
    digest = f"md5('42|' || {scope} || '|{name}|permutation')"
    start = f"(1 + ('0x' || substr({digest}, 1, 8))::BIGINT % greatest(1, least(2147483647, {2 ** 61} // {size})))"
    factor = f"(SELECT min({start} + i) FROM range(1000) t(i) WHERE gcd({start} + i, {size}) = 1)"
    return f"{factor} % {size} AS f, ('0x' || substr({digest}, 9, 8))::BIGINT % {size} AS s"


def with_source(rows: str, chunk: str, pct: float, name: str, offset: str = "0") -> str:
    """row, and src, the row whose key it takes, for ``rows`` rows from ``offset`` on."""
    scope = f"'{name}|' || {offset}"
    return f"""
SELECT {offset} + place AS row, {offset} + CASE WHEN rank < greatest(1, floor({chunk} * {pct}::DOUBLE)::BIGINT)
  THEN place - place % {chunk} + (q.f * rank + q.s) % {chunk} ELSE place END AS src
FROM (SELECT range AS place, (p.f * (range % {chunk}) + p.s) % {chunk} AS rank
      FROM range({rows}), (SELECT {coprime('duplicate targets', chunk, scope)}) p),
     (SELECT {coprime('duplicate sources', chunk, scope)}) q"""


def spec_children(rows: str, chunk: str, offset: str = "0") -> str:
    return with_source(rows, chunk, 0.02, "children", offset)


def child_cells(start: str, span: str) -> str:
    amount = rounded(CHILD, "amount", 0.0, 500.0, 2)
    times = {n: f"make_timestamp(({start} + {CHILD.pick(span, n)}) * 1000000)" for n in ("shipped", "created_at")}
    return f"""{permutation('children', 'id', KEY_RANGE, 'src')} AS id,
  CASE WHEN {CHILD.hit(0.02, 'amount', 'negative')} THEN -abs({amount}) ELSE {amount} END AS amount,
  {CHILD.word(list('abcd'), 'status')} AS status,
  {nulled(CHILD, 'shipped', 0.1, f"{times['shipped']}::DATE::VARCHAR")} AS shipped,
  CASE WHEN {times['created_at']} >= TIMESTAMP '2024-07-01' THEN {CHILD.word(['web', 'shop'], 'channel')} END
  AS channel, {stamp(times['created_at'])} AS created_at"""


N_ORDERS, N_CUSTOMERS = "(SELECT count(*) FROM orders)", "(SELECT count(*) FROM customer)"
PARENT_ID = f"1 + {permutation('parents', 'id', KEY_RANGE, 'range')}"


def spec_table(parents: str, children: str, offset: str) -> str:
    return f"""
WITH pool AS ({pool(f"SELECT {PARENT_ID} AS key FROM range({offset}, {offset} + {parents})", "500000")}),
child AS (SELECT row, src, {CHILD.hit(0.05, 'parent_id', 'orphan')} AS lost, {CHILD.uuid('parent_id')} AS fresh,
  {CHILD.pick('(SELECT count(*) FROM pool)', 'parent_id', 'parent')} AS pick
  FROM ({spec_children(children, children, offset)}))
SELECT {child_cells("epoch(TIMESTAMP '2024-01-01')::BIGINT", str(365 * 86400))},
  CASE WHEN lost THEN fresh ELSE key::VARCHAR END AS parent_id FROM child JOIN pool ON pick = ix"""


ORACLES["spec_tables"] = spec_table(N_CUSTOMERS, N_ORDERS, "0")
ORACLES["spec_increment"] = spec_table(N_CUSTOMERS, N_CUSTOMERS, N_ORDERS)
ORACLES["run_repeated"] = f"""
SELECT *, 0 AS run_no FROM ({ORACLES["spec_tables"]}) UNION ALL BY NAME
SELECT *, 1 AS run_no FROM ({ORACLES["spec_increment"]})"""
ORACLES["run_totals"] = f"""
SELECT 0 AS run, 2::BIGINT AS outputs, {N_CUSTOMERS} + {N_ORDERS} AS total_records, {N_CUSTOMERS} + {N_ORDERS} AS held_rows
UNION ALL SELECT 1, 2, 2 * {N_CUSTOMERS}, 3 * {N_CUSTOMERS} + {N_ORDERS}"""
SPEC_DAY = f"greatest({N_CUSTOMERS} // 30, 1)"
ORACLES["spec_days"] = same_day(
    f"SELECT *, DATE '2024-01-01' + (row // {SPEC_DAY})::INT AS day FROM ({spec_children(f'(30 * {SPEC_DAY})', SPEC_DAY)})",
    CHILD, "parent_id", 0.05,
    f"SELECT DATE '2024-01-01' + (range // {SPEC_DAY})::INT AS by_day, {PARENT_ID} AS parent FROM range(30 * {SPEC_DAY})",
    f"day::VARCHAR AS day, {child_cells('epoch(day)::BIGINT', '86400')}")

PER_FILE = f"greatest({N_EVENTS} // 20, 1)"
SHIP = Draw("ship", "row")
ORACLES["spec_files"] = f"""
SELECT file_no, file_date::VARCHAR AS file_date, {permutation('ship', 'tracking', KEY_RANGE, 'src')} AS tracking,
  {stamp(f"make_timestamp((epoch(file_date)::BIGINT + {SHIP.pick(86400, 'at')}) * 1000000)")} AS at,
  {nulled(SHIP, 'quantity', 0.1, f"1 + {SHIP.pick(9, 'quantity')}")} AS quantity,
  {SHIP.word(['air', 'road', 'sea'], 'mode')} AS mode
FROM (SELECT row, src, row // {PER_FILE} AS file_no, DATE '2024-01-01' + (7 * (row // {PER_FILE}))::INT AS file_date
      FROM ({with_source(f'(20 * {PER_FILE})', PER_FILE, 0.02, 'ship')}))"""
COURIER, CODE = Draw("courier", "row"), Draw("courier", "s_code")
WEIGHT = COURIER.pick(1001, "weight")
AT = f"make_timestamp((epoch(TIMESTAMP '2024-01-01')::BIGINT + {COURIER.pick(365 * 86400, 'at')}) * 1000000)"
BACK = f"to_hours((1 + {COURIER.pick(71, 'at', 'stale hours')})::INT)"
ORACLES["spec_api"] = f"""
SELECT row, '1Z' || {' || '.join(letters(CODE, 'code', i, ANY) for i in range(4))} AS code,
  CASE WHEN {COURIER.hit(0.02, 'weight', 'negative')} THEN -abs({WEIGHT}) ELSE {WEIGHT} END AS weight,
  {stamp(f"CASE WHEN {COURIER.hit(0.05, 'at', 'stale')} THEN {AT} - {BACK} ELSE {AT} END")} AS at,
  {COURIER.hit(0.05, 'soft delete')} AS is_deleted
FROM (SELECT row, row // 100 * 5000
        + {COURIER.pick("least(5000, least(100, n - row // 100 * 100) + 1)", 'code', 'slot')} AS s_code
      FROM (SELECT range AS row, {N_EVENTS} AS n FROM range({N_EVENTS})))"""

# ------------------------------------------------------------------ streams

ORACLES["stream_daily_append"] = """
SELECT ts::DATE::VARCHAR AS day, count(*) AS rows, sum(event_id)::BIGINT AS id_sum FROM events GROUP BY 1"""
ORACLES["stream_closed_days"] = f"""
WITH late AS ({LATE})
SELECT {stamp("date_trunc('day', ts)")} AS day_start, count(*) AS rows FROM late
GROUP BY date_trunc('day', ts)
HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM late) - INTERVAL 11 DAY"""

# ------------------------------------------------------------------- audits

ORACLES["range_audit"] = long_form("SELECT * FROM lineitem", {
    c: {"below": f"{c} < {low}::DOUBLE", "above": f"{c} > {high}::DOUBLE"}
    for c, (low, high) in {"l_quantity": (5.0, 40.0), "l_discount": (0.01, 0.05), "l_linenumber": (2, 6)}.items()})
ORACLES["choice_audit"] = long_form("SELECT * FROM lineitem", {
    "l_returnflag": {"unlisted": "l_returnflag NOT IN ('A', 'R')"},
    "l_linestatus": {"unlisted": "l_linestatus NOT IN ('O')"}})
ORACLES["row_count_audit"] = "\nUNION ALL ".join(
    f"SELECT '{t}' AS \"table\", 1000::BIGINT AS target_rows, count(*) AS actual_rows, "
    f"1000 - count(*) AS missing_rows FROM {t}"
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
              "embeddings", "pages", "benchmark", "labels", "conversations"))
