"""Queries over generated rows, and SQL that draws the same hashes and works every answer out on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from decisium.plans.base import query
from decisium.sources import generators as G

N_ROWS = 200


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values) + "]"


def _key(family: str, name: str, row: str = "row_no") -> str:
    return f"'7|{family}|' || {row} || '|{name}'"


def _number(family: str, name: str, low: int, high: int) -> str:
    return f"CAST(CAST('0x' || substr(sha256({_key(family, name)}), 1, 8) AS BIGINT) % {high - low + 1} + {low} AS INT)"


def _pick(family: str, name: str, values: str, row: str = "row_no") -> str:
    return f"({values})[CAST('0x' || substr(sha256({_key(family, name, row)}), 1, 8) AS BIGINT) % len({values}) + 1]"


def _order(family: str, name: str, values: str, row: str = "row_no") -> str:
    keys = f"list_sort(list_transform(range(0, len({values})), lambda i: sha256({_key(family, name, row)} || '|' || i) || '|' || i))"
    return f"list_transform({keys}, lambda k: ({values})[CAST(split_part(k, '|', 2) AS INT) + 1])"


def _joined(values: str, by: str = ", ") -> str:
    return f"array_to_string({values}, '{by}')"


def _near(value: str) -> str:
    return "[" + ", ".join(f"CAST({value} + ({s}) AS VARCHAR)" for s in (1, -1, 2, -2, 10, -10, 5, -5, 3, 7, 11, 20)) + "]"


_FIRSTS, _SECONDS = (lambda pairs: _list([a for a, _ in pairs])), (lambda pairs: _list([b for _, b in pairs]))
_TABLE = "[" + ", ".join(_list(v) for v in G.KINDS.values()) + "]"
_CLOCK = "printf('%02d:%02d', CAST((({m}) % 1440) // 60 AS INT), CAST(({m}) % 60 AS INT))"


def _clock(m: str) -> str:
    return _CLOCK.format(m=m)


def _terms(i: int) -> str:
    return f"CAST(CASE kind WHEN 0 THEN a + s * {i} WHEN 1 THEN a * {2**i} ELSE a + {i // 2} * s + {i % 2} END AS BIGINT)"


def specification(f: str) -> tuple[list[str], str, str, str, str]:
    """(named values, context, question, gold, wrong candidates) of a family as SQL."""
    n, o = (lambda name, low, high: f"{_number(f, name, low, high)} AS {name}_"), (lambda name, values, alias: f"{_order(f, name, values)} AS {alias}")
    places, ports, coins, people, things, events = (_list(x) for x in (G.PLACES, G.PORTS, G.COINS, G.PEOPLE, G.THINGS, G.EVENTS))
    pairs = lambda k, text: _joined(f"list_transform(range(1, {k} + 1), lambda k: {text})", " ")
    asked = lambda first, second, question: ([n("i", 0, len(first) - 1)], "''", question, f"{_list(second)}[i_ + 1]", _list(second))
    if f in ("retrieval", "permuted"):
        return [o("place", places, "p"), o("port", ports, "q"), n("which", 0, 3)], pairs(4, "'The harbour of ' || p[k] || ' is ' || q[k] || '.'"), "'What is the harbour of ' || p[which_ + 1] || '?'", "q[which_ + 1]", "q"
    if f == "paraphrase":
        return [n("which", 0, len(G.INTENTS) - 1)], f"{_FIRSTS(G.INTENTS)}[which_ + 1]", "'What does the writer want?'", f"{_SECONDS(G.INTENTS)}[which_ + 1]", _SECONDS(G.INTENTS)
    if f == "order":
        return [o("events", events, "e"), n("which", 0, 2)], "'First ' || e[1] || ', then ' || e[2] || ', and last ' || e[3] || '.'", "'What happened ' || ['first', 'second', 'last'][which_ + 1] || '?'", "e[which_ + 1]", "e"
    if f == "ambiguity":
        return [o("people", people, "p")], "p[1] || ' told ' || p[2] || ' that the work was done.'", "'Who had done the work?'", "CAST(NULL AS VARCHAR)", "p[1:8]"
    if f == "numeric":
        gold = "CASE op_ WHEN 0 THEN a_ + b_ + c_ WHEN 1 THEN greatest(a_, b_, c_) ELSE greatest(a_, b_, c_) - least(a_, b_, c_) END"
        asks = _list(["What do they add up to?", "Which is the largest number?", "By how much does the largest exceed the smallest?"])
        return [*(n(x, 10, 90) for x in "abc"), n("op", 0, 2), f"{gold} AS g"], "'The boxes hold ' || a_ || ', ' || b_ || ' and ' || c_ || ' nails.'", f"{asks}[op_ + 1]", "CAST(g AS VARCHAR)", _near("g")
    if f == "spatial":
        lets = [o("things", things, "t"), n("which", 1, 5), n("side", 0, 1)]
        ask = "'What stands right next to the ' || t[which_ + 1] || ' on its ' || CASE side_ WHEN 1 THEN 'right' ELSE 'left' END || '?'"
        return lets, f"'From left to right stand: ' || {_joined('t[1:7]')} || '.'", ask, "CASE side_ WHEN 1 THEN t[which_ + 2] ELSE t[which_] END", "t"
    if f == "compare":
        lets = [o("people", people, "p"), f"({_order(f, 'ages', _list(range(20, 60)))})[1:4] AS ages", n("most", 0, 1)]
        best = "list_position(ages, CASE most_ WHEN 1 THEN list_max(ages) ELSE list_min(ages) END)"
        return lets, pairs(4, "p[k] || ' is ' || ages[k] || '.'"), "CASE most_ WHEN 1 THEN 'Who is the oldest?' ELSE 'Who is the youngest?' END", f"p[{best}]", "p"
    if f == "oddoneout":
        lets = [n("kind", 0, 7), n("other", 1, 7), f"({_TABLE})[kind_ + 1] AS own", f"({_TABLE})[(kind_ + other_) % 8 + 1] AS rest", f"{_pick(f, 'odd', 'rest')} AS g", "list_append(own[1:4], g) AS items", o("shown", "items", "shown")]
        return lets, f"'These are named: ' || {_joined('shown')} || '.'", "'Which one doesn''t belong to the others?'", "g", "list_concat(own[1:4], list_filter(rest, lambda x: x <> g))"
    if f == "category":
        lets = [n("kind", 0, 7), f"({_TABLE})[kind_ + 1] AS own", f"{_pick(f, 'item', 'own')} AS item"]
        return lets, "''", "'What kind of thing is the ' || item || '?'", f"{_list(G.KINDS)}[kind_ + 1]", _list(G.KINDS)
    if f == "property":
        return [o("people", people, "p"), o("coins", coins, "c"), n("which", 0, 3)], pairs(4, "p[k] || ' pays in the ' || c[k] || '.'"), "'Who pays in the ' || c[which_ + 1] || '?'", "p[which_ + 1]", "p"
    if f == "negation":
        return [o("things", things, "t")], f"'The shop sells these: ' || {_joined('t[1:7]')} || '.'", "'Which of these doesn''t the shop sell?'", "t[8]", "t[1:7]"
    if f == "conditional":
        ways = ["send it by boat", "send it by train", "keep it", "sell it", "burn it", "give it away", "hide it", "paint it"]
        text = "'If a load weighs more than ' || limit_ || ' stone, they send it by boat, else by train. This one weighs ' || n_ || ' stone.'"
        return [n("limit", 20, 60), n("n", 5, 80)], text, "'What do they do?'", f"{_list(ways)}[CASE WHEN n_ > limit_ THEN 1 ELSE 2 END]", _list(ways)
    if f == "arithmetic":
        gold = "CAST(CASE op_ WHEN 0 THEN a_ + b_ WHEN 1 THEN a_ - b_ WHEN 2 THEN a_ * b_ WHEN 3 THEN (a_ + b_) // 2 ELSE (a_ * b_) // 10 END AS BIGINT)"
        ask = "CASE op_ WHEN 0 THEN 'What is ' || a_ || ' plus ' || b_ || '?' WHEN 1 THEN 'What is ' || a_ || ' minus ' || b_ || '?' WHEN 2 THEN 'What is ' || a_ || ' times ' || b_ || '?' WHEN 3 THEN 'What is the whole part of the mean of ' || a_ || ' and ' || b_ || '?' ELSE 'What is the whole part of ' || b_ || ' percent of ' || (a_ * 10) || '?' END"
        return [n("a", 11, 99), n("b", 2, 19), n("op", 0, 4), f"{gold} AS g"], "''", ask, "CAST(g AS VARCHAR)", _near("g")
    if f == "counting":
        lets = [n("n", 2, 6), n("m", 1, 5), o("things", things, "t"), "list_concat(t[1:n_], list_transform(range(0, m_), lambda x: t[12])) AS items", o("shown", "items", "shown")]
        return lets, f"'On the table lie: ' || {_joined('shown')} || '.'", "'How many times is the ' || t[12] || ' named?'", "CAST(len(list_filter(shown, lambda x: x = t[12])) AS VARCHAR)", _list([str(i) for i in range(12)])
    if f == "sets":
        lets = [o("things", things, "t"), "t[1:5] AS a", "t[4:9] AS b", n("op", 0, 2)]
        gold = "CASE op_ WHEN 0 THEN len(list_intersect(a, b)) WHEN 1 THEN len(list_filter(a, lambda x: NOT list_contains(b, x))) ELSE len(list_distinct(list_concat(a, b))) END"
        asks = _list(["How many things do both have?", "How many things has only the first?", "How many different things do they have together?"])
        return lets, f"'The first has: ' || {_joined('a')} || '. The other has: ' || {_joined('b')} || '.'", f"{asks}[op_ + 1]", f"CAST({gold} AS VARCHAR)", _list([str(i) for i in range(13)])
    if f == "beforeafter":
        lets = [o("events", events, "e"), n("which", 1, 2), n("after", 0, 1)]
        ask = "'What came right ' || CASE after_ WHEN 1 THEN 'after' ELSE 'before' END || ' this: ' || e[which_ + 1] || '?'"
        return lets, f"'In this order: ' || {_joined('e[1:4]', '; ')} || '.'", ask, "CASE after_ WHEN 1 THEN e[which_ + 2] ELSE e[which_] END", "e"
    if f == "ordinal":
        return [o("people", people, "p"), n("which", 0, 7)], f"'They arrived in this order: ' || {_joined('p[1:8]')} || '.'", "'In which place did ' || p[which_ + 1] || ' arrive?'", f"{_list(G.ORDINALS)}[which_ + 1]", _list(G.ORDINALS)
    if f == "sequence_next":
        lets = [_number(f, "a", 1, 20) + " AS a", _number(f, "s", 2, 9) + " AS s", _number(f, "kind", 0, 2) + " AS kind", f"{_terms(4)} AS g"]
        return lets, "''", "'Which number comes next: ' || " + " || ', ' || ".join(_terms(i) for i in range(4)) + " || '?'", "CAST(g AS VARCHAR)", _near("g")
    if f == "timeclock":
        wrong = "[" + ", ".join(_clock(f"t_ + plus_ + ({x}) + 1440") for x in (60, -60, 10, -10, 30, -30, 5, -5, 120)) + "]"
        return [n("t", 0, 1439), n("plus", 15, 700)], f"'It is ' || {_clock('t_')} || '.'", "'What time is it ' || plus_ || ' minutes later?'", _clock("t_ + plus_"), wrong
    if f == "dates":
        days, months = _list(G.DAYS), _list(G.MONTHS)
        ask = f"CASE month_ WHEN 1 THEN 'It is ' || {months}[i_ + 1] || '. Which month is it in ' || n_ || ' months?' ELSE 'It is ' || {days}[i_ % 7 + 1] || '. Which day is it in ' || n_ || ' days?' END"
        gold = f"CASE month_ WHEN 1 THEN {months}[(i_ + n_) % 12 + 1] ELSE {days}[(i_ + n_) % 7 + 1] END"
        return [n("i", 0, 11), n("n", 2, 40), n("month", 0, 1)], "''", ask, gold, f"CASE month_ WHEN 1 THEN {months} ELSE {_list([*G.DAYS, 'no day'])} END"
    if f == "negprop":
        lets = [o("people", people, "p"), o("coins", coins, "c"), n("which", 0, 7)]
        return lets, pairs(8, "p[k] || ' pays in the ' || CASE WHEN k = which_ + 1 THEN c[2] ELSE c[1] END || '.'"), "'Who doesn''t pay in the ' || c[1] || '?'", "p[which_ + 1]", "p[1:8]"
    if f == "analogy":
        a, b = _FIRSTS(G.ANTONYMS), _SECONDS(G.ANTONYMS)
        lets = [n("i", 0, len(G.ANTONYMS) - 1), n("j", 1, len(G.ANTONYMS) - 1), f"(i_ + j_) % {len(G.ANTONYMS)} AS k"]
        return lets, "''", f"{a}[i_ + 1] || ' is to ' || {b}[i_ + 1] || ' as ' || {a}[k + 1] || ' is to what?'", f"{b}[k + 1]", b
    if f in ("define", "knowledge", "synonym", "antonym"):
        bank = {"define": G.GLOSSES, "knowledge": G.KNOWN, "synonym": G.SYNONYMS, "antonym": G.ANTONYMS}[f]
        begins = {"define": "What is ", "knowledge": "", "synonym": "Which word means the same as ", "antonym": "Which word means the opposite of "}[f]
        first = [a for a, _ in bank]
        return asked(first, [b for _, b in bank], f"'{begins}' || {_list(first)}[i_ + 1] || '{'' if f == 'knowledge' else '?'}'")
    if f == "transitivity":
        lets = [o("people", people, "p"), n("which", 0, 4), "list_transform(range(1, 5), lambda k: p[k] || ' is taller than ' || p[k + 1] || '.') AS said", o("shown", "said", "shown")]
        return lets, _joined("shown", " "), f"'Who is the ' || {_list(G.ORDINALS)}[which_ + 1] || ' tallest of the five?'", "p[which_ + 1]", "p"
    if f == "distribution":
        lets = [n("a", 1, 5), n("b", 1, 5), n("n", 20, 200), "CAST((n_ * a_) // (a_ + b_) AS BIGINT) AS g"]
        return lets, "n_ || ' coins are shared in the ratio ' || a_ || ' to ' || b_ || '.'", "'How many whole coins does the first get?'", "CAST(g AS VARCHAR)", _near("g")
    raise KeyError(f)


def rows_sql(f: str) -> str:
    """id, family, row_no, context, question, options (a list) and correct_index of the family's rows."""
    lets, context, question, gold, wrong = specification(f)
    named = "".join(f", {x}" for x in lets)
    return f"""SELECT sha256('{f}|7|' || row_no) AS id, '{f}' AS family, row_no, context, question,
  CASE WHEN gold IS NULL THEN wrong ELSE list_transform(ks, lambda k: list_concat([gold], wrong)[CAST(split_part(k, '|', 2) AS INT) + 1]) END AS options,
  CASE WHEN gold IS NOT NULL THEN CAST(list_position(list_transform(ks, lambda k: split_part(k, '|', 2)), '0') - 1 AS INT) END AS correct_index
FROM (SELECT *, list_filter(drawn, lambda v, i: list_position(drawn, v) = i AND v IS DISTINCT FROM gold)[1:CASE WHEN gold IS NULL THEN 8 ELSE 7 END] AS wrong, list_sort(list_transform(range(0, 8), lambda i: sha256('7|' || row_no || '|' || i) || '|' || i)) AS ks
  FROM (SELECT *, {_order(f, "options", "candidates")} AS drawn FROM (SELECT row_no{named}, {context} AS context, {question} AS question, {gold} AS gold, {wrong} AS candidates FROM range({N_ROWS}) r(row_no))))"""


def _family(name: str) -> None:
    @query(f"gen_{name}", f"SELECT id, family, context, question, {_joined('options', '|')} AS options, correct_index FROM ({rows_sql(name)})")
    def generate(spark, sf_dir):
        df = G.rows(spark, name, N_ROWS)
        return df.select("id", "family", "context", "question", F.array_join("options", "|").alias("options"), "correct_index")


for _name in G.FAMILIES:
    _family(_name)


def seeds_sql(f: str) -> str:
    """row_no, family, seed (as JSON), line and expected of a chain's seeds."""
    n = lambda name, low, high: _number(f, name, low, high)
    if f == "chain_arithmetic":
        lets = f"{n('a', 9, 96)} AS a, {n('b', 2, 23)} AS b, {_pick(f, 'op', _list(['add', 'sub', 'mul']))} AS op"
        seed, line = """'{"a":' || a || ',"b":' || b || ',"op":"' || op || '"}'""", "'Start from ' || a || ', apply ' || op || ' with ' || b || '.'"
        expected = "CAST(CASE op WHEN 'add' THEN a + b WHEN 'sub' THEN a - b ELSE a * b END AS VARCHAR)"
    elif f == "chain_logic":
        lets = f"{_order(f, 'people', _list(G.PEOPLE))} AS p"
        seed, line = """'{"x":"' || p[1] || '","y":"' || p[2] || '","z":"' || p[3] || '"}'""", "'If ' || p[1] || ' then ' || p[2] || '; if ' || p[2] || ' then ' || p[3] || '.'"
        expected = "p[3]"
    elif f == "chain_sequence":
        lets = f"({_order(f, 'things', _list(G.THINGS))})[1:4] AS t, {n('offset', 1, 3)} AS step"
        seed = """'{"items":["' || array_to_string(t, '","') || '"],"offset":' || step || '}'"""
        line, expected = "'Use the items ' || array_to_string(t, ', ') || ' in this order and ask for the one ' || step || ' after the first.'", "t[step + 1]"
    else:
        lets = f"{n('v', 24, 980)} AS v, CASE {n('change', 0, 1)} WHEN 1 THEN 'add' ELSE 'take' END AS change, {n('k', 2, 11)} AS k"
        seed = """'{"v":' || v || ',"change":"' || change || '","k":' || k || '}'"""
        line, expected = "'State the value ' || v || ', then ' || change || ' ' || k || '.'", "CAST(CASE change WHEN 'add' THEN v + k ELSE v - k END AS VARCHAR)"
    return f"SELECT row_no, '{f}' AS family, {seed} AS seed, {line} AS line, {expected} AS expected FROM (SELECT row_no, {lets} FROM range({N_ROWS}) r(row_no))"


def _chain(name: str) -> None:
    @query(f"gen_{name}_seeds", seeds_sql(name))
    def seeds(spark, sf_dir):
        df = G.chain_seeds(spark, name, N_ROWS)
        return df.select("row_no", "family", F.to_json("seed").alias("seed"), G.seed_line(name, F.col("seed")).alias("line"), "expected")

    @query(f"verify_{name}", f"SELECT row_no, row_no % 3 > 0 AS verified, row_no % 3 > 0 AS wanted FROM range({N_ROWS}) r(row_no)")
    def verify(spark, sf_dir):
        """Rows that honour their seeds, and each third one with a wrong answer."""
        df = G.chain_seeds(spark, name, N_ROWS)
        text = F.concat(G.seed_line(name, F.col("seed")), F.lit(" It is done."))
        gold = F.when(F.col("row_no") % 3 == 0, F.lit("none")).otherwise(F.concat(F.col("expected"), F.lit(" it is")))
        return df.select("row_no", G.verified(name, text, gold, F.col("seed")).alias("verified"), (F.col("row_no") % 3 > 0).alias("wanted"))


for _name in G.CHAINS:
    _chain(_name)


_NOISE = f"""WITH g AS ({rows_sql("retrieval")}),
d AS (SELECT *, {_pick("noise", "n", "[1, 1, 2, 2, 3]", "id")} AS wanted, ({_order("noise", "fillers", _list(G.FILLERS), "id")})[1:3] AS drawn FROM g),
u AS (SELECT *, list_filter(drawn, lambda x: len(list_filter(options, lambda y: contains(lower(x), lower(y)))) = 0)[1:wanted] AS fillers FROM d)
SELECT sha256('noise|' || id) AS id, id AS source_id, context || ' ' || array_to_string(fillers, ' ') AS context, CAST(len(fillers) AS INT) AS noise_injected, correct_index FROM u WHERE len(fillers) > 0"""


@query("gen_noise", _NOISE)
def gen_noise(spark, sf_dir):
    df = G.noised(G.rows(spark, "retrieval", N_ROWS))
    return df.select("id", "source_id", "context", "noise_injected", "correct_index")
