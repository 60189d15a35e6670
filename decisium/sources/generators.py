"""Generated question families as columns over ``spark.range``.

Every draw is a hash of (seed, family, row, name of the draw), so rows don't depend
on partitioning and any row can be made again on its own. A family gives context,
question, gold and candidate wrong answers; ``rows`` makes eight distinct options of
them in seeded order. Banks are this module's own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decisium.functions.arrays import default_probs
from decisium.functions.hashing import sha_order, sha_place
from decisium.operators.mining import with_options

N_OPTIONS = 8
PLACES = ["Arlen", "Brova", "Caldis", "Dorne", "Elvar", "Fintal", "Gorma", "Hestia", "Irvane", "Jastow", "Kelmar", "Lunden"]
PORTS = ["Amberport", "Birchford", "Coldwater", "Dunmore", "Eastmere", "Foxhaven", "Greyton", "Highmoor", "Inverness Bay", "Jade Harbor", "Kingsreach", "Lakeside"]
COINS = ["crown", "thaler", "florin", "ducat", "shilling", "guilder", "peseta", "rupel", "kron", "lira", "mark", "dinar"]
PEOPLE = ["Ada", "Bram", "Cleo", "Dirk", "Elsa", "Finn", "Gwen", "Hugo", "Iris", "Jonas", "Kira", "Leo"]
THINGS = ["lamp", "kettle", "ladder", "basket", "mirror", "compass", "blanket", "hammer", "candle", "violin", "saddle", "anchor"]
EVENTS = ["the bell rang", "the gate opened", "the rain began", "the choir sang", "the lamp was lit", "the train left", "the letter arrived", "the bread was baked", "the boat landed", "the clock stopped"]
KINDS = {
    "bird": ["wren", "heron", "osprey", "finch", "plover"],
    "tree": ["alder", "cedar", "hazel", "rowan", "larch"],
    "metal": ["copper", "nickel", "zinc", "cobalt", "tin"],
    "fish": ["perch", "trout", "sturgeon", "bream", "carp"],
    "tool": ["chisel", "pliers", "mallet", "wrench", "rasp"],
    "fruit": ["quince", "damson", "medlar", "apricot", "mulberry"],
    "cloth": ["linen", "velvet", "denim", "satin", "tweed"],
    "gem": ["opal", "garnet", "topaz", "beryl", "jasper"],
}
SYNONYMS = [("rapid", "quick"), ("silent", "quiet"), ("huge", "enormous"), ("begin", "start"), ("buy", "purchase"), ("sad", "unhappy"), ("brave", "bold"), ("ill", "sick"), ("odd", "strange"), ("end", "finish"), ("rich", "wealthy"), ("shut", "close")]
ANTONYMS = [("hot", "cold"), ("early", "late"), ("wide", "narrow"), ("deep", "shallow"), ("loud", "soft"), ("heavy", "light"), ("sharp", "blunt"), ("full", "empty"), ("rough", "smooth"), ("old", "new"), ("dry", "wet"), ("rare", "common")]
GLOSSES = [("a ledger", "a book in which money is recorded"), ("a quay", "a wall where ships are loaded"), ("a kiln", "an oven in which clay is fired"), ("a sextant", "an instrument that measures angles at sea"), ("a trellis", "a frame on which plants climb"), ("a moat", "a ditch of water around a castle"), ("a loom", "a machine on which cloth is woven"), ("a granary", "a building in which grain is kept"), ("a beacon", "a light that guides ships"), ("a cellar", "a room below a house")]
KNOWN = [("How many days has a week?", "seven"), ("How many sides has a hexagon?", "six"), ("Which season follows spring?", "summer"), ("What do bees make?", "honey"), ("Which planet do we live on?", "Earth"), ("What is frozen water called?", "ice"), ("How many legs has a spider?", "eight"), ("Which colour do blue and yellow make?", "green"), ("What do cows give to drink?", "milk"), ("In which direction does the sun rise?", "east")]
INTENTS = [("Could you send the parcel again?", "ask for a delivery"), ("I would like my money back.", "ask for a refund"), ("When do you open on Sunday?", "ask for opening hours"), ("My password no longer works.", "report a login problem"), ("Please cancel my order.", "cancel an order"), ("Do you have this in blue?", "ask for a colour"), ("I moved to another street.", "change an address"), ("The screen arrived broken.", "report damage"), ("Can I pay by card?", "ask about payment")]
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth"]


def _array(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


class Draw:
    """Seeded draws of one row; ``name`` tells the draws of a row apart."""

    def __init__(self, seed: int, family: str, row: Column):
        self.seed, self.key = seed, (F.lit(family), row)

    def number(self, name: str, low: int, high: int) -> Column:
        return (sha_place(self.seed, F.lit(high - low + 1), *self.key, F.lit(name)) + low).cast("int")

    def pick(self, name: str, values: list | Column) -> Column:
        a = _array(values) if isinstance(values, list) else values
        return F.get(a, sha_place(self.seed, F.size(a), *self.key, F.lit(name)))

    def order(self, name: str, values: list | Column) -> Column:
        """All values in drawn order."""
        a = _array(values) if isinstance(values, list) else values
        keyed = F.transform(a, lambda x, i: F.struct(sha_order(self.seed, *self.key, F.lit(name), i).alias("k"), x.alias("x")))
        return F.transform(F.array_sort(keyed), lambda s: s["x"])


def _say(pattern: str, *args: Column) -> Column:
    return F.format_string(pattern, *args)


def _near(value: Column, *steps: int) -> Column:
    """Other numbers around ``value``, as text."""
    return F.array(*[(value + s).cast("string") for s in (steps or (1, -1, 2, -2, 10, -10, 5, -5, 3, 7, 11, 20))])


Parts = tuple[Column, Column, Column, Column]  # context, question, gold, wrong candidates
FAMILIES: dict[str, Callable[[Draw], Parts]] = {}


def family(f: Callable[[Draw], Parts]) -> Callable[[Draw], Parts]:
    FAMILIES[f.__name__] = f
    return f


@family
def retrieval(d: Draw) -> Parts:
    p, q = d.order("place", PLACES), d.order("port", PORTS)
    i = d.number("which", 0, 3)
    lines = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: _say("The harbour of %s is %s.", F.get(p, k), F.get(q, k))), " ")
    return lines, _say("What is the harbour of %s?", F.get(p, i)), F.get(q, i), q


@family
def paraphrase(d: Draw) -> Parts:
    i = d.number("which", 0, len(INTENTS) - 1)
    return F.get(_array([a for a, _ in INTENTS]), i), F.lit("What does the writer want?"), F.get(_array([b for _, b in INTENTS]), i), _array([b for _, b in INTENTS])


@family
def order(d: Draw) -> Parts:
    e, i = d.order("events", EVENTS), d.number("which", 0, 2)
    text = _say("First %s, then %s, and last %s.", F.get(e, F.lit(0)), F.get(e, F.lit(1)), F.get(e, F.lit(2)))
    return text, _say("What happened %s?", F.get(_array(["first", "second", "last"]), i)), F.get(e, i), e


@family
def ambiguity(d: Draw) -> Parts:
    p = d.order("people", PEOPLE)
    return _say("%s told %s that the work was done.", F.get(p, F.lit(0)), F.get(p, F.lit(1))), F.lit("Who had done the work?"), F.lit(None).cast("string"), F.slice(p, 1, N_OPTIONS)


@family
def permuted(d: Draw) -> Parts:
    return retrieval(d)


@family
def numeric(d: Draw) -> Parts:
    a, b, c = (d.number(x, 10, 90) for x in "abc")
    op = d.number("op", 0, 2)
    gold = F.when(op == 0, a + b + c).when(op == 1, F.greatest(a, b, c)).otherwise(F.greatest(a, b, c) - F.least(a, b, c))
    q = F.get(_array(["What do they add up to?", "Which is the largest number?", "By how much does the largest exceed the smallest?"]), op)
    return _say("The boxes hold %d, %d and %d nails.", a, b, c), q, gold.cast("string"), _near(gold)


@family
def spatial(d: Draw) -> Parts:
    t, i = d.order("things", THINGS), d.number("which", 1, 5)
    right = d.number("side", 0, 1) == 1
    row = F.array_join(F.slice(t, 1, 7), ", ")
    return _say("From left to right stand: %s.", row), _say("What stands right next to the %s on its %s?", F.get(t, i), F.when(right, "right").otherwise("left")), F.when(right, F.get(t, i + 1)).otherwise(F.get(t, i - 1)), t


@family
def compare(d: Draw) -> Parts:
    p = d.order("people", PEOPLE)
    base = d.order("ages", list(range(20, 60)))
    most = d.number("most", 0, 1) == 1
    ages = F.slice(base, 1, 4)
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: _say("%s is %d.", F.get(p, k), F.get(ages, k))), " ")
    best = F.array_position(ages, F.when(most, F.array_max(ages)).otherwise(F.array_min(ages))) - 1
    return text, F.when(most, F.lit("Who is the oldest?")).otherwise("Who is the youngest?"), F.get(p, best.cast("int")), p


@family
def oddoneout(d: Draw) -> Parts:
    names = list(KINDS)
    k, j = d.number("kind", 0, len(names) - 1), d.number("other", 1, len(names) - 1)
    table = F.array(*[_array(KINDS[n]) for n in names])
    own, other = F.get(table, k), F.get(table, F.pmod(k + j, F.lit(len(names))))
    gold = d.pick("odd", other)
    shown = d.order("shown", F.concat(F.slice(own, 1, 4), F.array(gold)))
    return _say("These are named: %s.", F.array_join(shown, ", ")), F.lit("Which one doesn't belong to the others?"), gold, F.concat(F.slice(own, 1, 4), F.array_except(other, F.array(gold)))


@family
def category(d: Draw) -> Parts:
    names = list(KINDS)
    k = d.number("kind", 0, len(names) - 1)
    item = d.pick("item", F.get(F.array(*[_array(KINDS[n]) for n in names]), k))
    return F.lit(""), _say("What kind of thing is the %s?", item), F.get(_array(names), k), _array(names)


@family
def property(d: Draw) -> Parts:  # noqa: A001
    p, c = d.order("people", PEOPLE), d.order("coins", COINS)
    i = d.number("which", 0, 3)
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: _say("%s pays in the %s.", F.get(p, k), F.get(c, k))), " ")
    return text, _say("Who pays in the %s?", F.get(c, i)), F.get(p, i), p


@family
def negation(d: Draw) -> Parts:
    t = d.order("things", THINGS)
    return _say("The shop sells these: %s.", F.array_join(F.slice(t, 1, 7), ", ")), F.lit("Which of these doesn't the shop sell?"), F.get(t, F.lit(7)), F.slice(t, 1, 7)


@family
def conditional(d: Draw) -> Parts:
    limit, n = d.number("limit", 20, 60), d.number("n", 5, 80)
    ways = ["send it by boat", "send it by train"]
    rest = ["keep it", "sell it", "burn it", "give it away", "hide it", "paint it"]
    return _say("If a load weighs more than %d stone, they send it by boat, else by train. This one weighs %d stone.", limit, n), F.lit("What do they do?"), F.when(n > limit, F.lit(ways[0])).otherwise(ways[1]), _array(ways + rest)


@family
def arithmetic(d: Draw) -> Parts:
    a, b, op = d.number("a", 11, 99), d.number("b", 2, 19), d.number("op", 0, 4)
    gold = F.when(op == 0, a + b).when(op == 1, a - b).when(op == 2, a * b).when(op == 3, F.floor((a + b) / 2)).otherwise(F.floor(a * 10 * b / 100)).cast("long")
    q = F.when(op == 0, _say("What is %d plus %d?", a, b)).when(op == 1, _say("What is %d minus %d?", a, b)).when(op == 2, _say("What is %d times %d?", a, b)).when(op == 3, _say("What is the whole part of the mean of %d and %d?", a, b)).otherwise(_say("What is the whole part of %d percent of %d?", b, a * 10))
    return F.lit(""), q, gold.cast("string"), _near(gold)


@family
def counting(d: Draw) -> Parts:
    n, m = d.number("n", 2, 6), d.number("m", 1, 5)
    t = d.order("things", THINGS)
    items = F.concat(F.slice(t, F.lit(1), n), F.array_repeat(F.get(t, F.lit(11)), m))
    shown = d.order("shown", items)
    return _say("On the table lie: %s.", F.array_join(shown, ", ")), _say("How many times is the %s named?", F.get(t, F.lit(11))), m.cast("string"), _array([str(i) for i in range(0, 12)])


@family
def sets(d: Draw) -> Parts:
    t = d.order("things", THINGS)
    a, b = F.slice(t, 1, 5), F.slice(t, 4, 6)
    op = d.number("op", 0, 2)
    gold = F.when(op == 0, F.array_intersect(a, b)).when(op == 1, F.array_except(a, b)).otherwise(F.array_union(a, b))
    q = F.get(_array(["How many things do both have?", "How many things has only the first?", "How many different things do they have together?"]), op)
    return _say("The first has: %s. The other has: %s.", F.array_join(a, ", "), F.array_join(b, ", ")), q, F.size(gold).cast("string"), _array([str(i) for i in range(0, 13)])


@family
def beforeafter(d: Draw) -> Parts:
    e, i = d.order("events", EVENTS), d.number("which", 1, 2)
    after = d.number("after", 0, 1) == 1
    text = _say("In this order: %s.", F.array_join(F.slice(e, 1, 4), "; "))
    return text, _say("What came right %s this: %s?", F.when(after, "after").otherwise("before"), F.get(e, i)), F.when(after, F.get(e, i + 1)).otherwise(F.get(e, i - 1)), e


@family
def ordinal(d: Draw) -> Parts:
    p, i = d.order("people", PEOPLE), d.number("which", 0, 7)
    return _say("They arrived in this order: %s.", F.array_join(F.slice(p, 1, 8), ", ")), _say("In which place did %s arrive?", F.get(p, i)), F.get(_array(ORDINALS), i), _array(ORDINALS)


@family
def sequence_next(d: Draw) -> Parts:
    a, s, kind = d.number("a", 1, 20), d.number("s", 2, 9), d.number("kind", 0, 2)

    def term(i: int) -> Column:
        return F.when(kind == 0, a + s * i).when(kind == 1, a * 2**i).otherwise(a + F.lit(i // 2) * s + F.lit(i % 2)).cast("long")

    gold = term(4)
    return F.lit(""), _say("Which number comes next: %d, %d, %d, %d?", *[term(i) for i in range(4)]), gold.cast("string"), _near(gold)


@family
def timeclock(d: Draw) -> Parts:
    t, plus = d.number("t", 0, 1439), d.number("plus", 15, 700)
    show = lambda m: _say("%02d:%02d", F.floor(F.pmod(m, F.lit(1440)) / 60).cast("int"), F.pmod(m, F.lit(60)).cast("int"))
    gold = t + plus
    return _say("It is %s.", show(t)), _say("What time is it %d minutes later?", plus), show(gold), F.array(*[show(gold + x + 1440) for x in (60, -60, 10, -10, 30, -30, 5, -5, 120)])


@family
def dates(d: Draw) -> Parts:
    i, n, month = d.number("i", 0, 11), d.number("n", 2, 40), d.number("month", 0, 1) == 1
    days, months = _array(DAYS), _array(MONTHS)
    day, gold_day = F.get(days, F.pmod(i, F.lit(7))), F.get(days, F.pmod(i + n, F.lit(7)))
    q = F.when(month, _say("It is %s. Which month is it in %d months?", F.get(months, i), n)).otherwise(_say("It is %s. Which day is it in %d days?", day, n))
    return F.lit(""), q, F.when(month, F.get(months, F.pmod(i + n, F.lit(12)))).otherwise(gold_day), F.when(month, months).otherwise(F.concat(days, F.array(F.lit("no day"))))


@family
def negprop(d: Draw) -> Parts:
    p, c, i = d.order("people", PEOPLE), d.order("coins", COINS), d.number("which", 0, 7)
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: _say("%s pays in the %s.", F.get(p, k), F.when(k == i, F.get(c, F.lit(1))).otherwise(F.get(c, F.lit(0))))), " ")
    return text, _say("Who doesn't pay in the %s?", F.get(c, F.lit(0))), F.get(p, i), F.slice(p, 1, 8)


@family
def analogy(d: Draw) -> Parts:
    i, j = d.number("i", 0, len(ANTONYMS) - 1), d.number("j", 1, len(ANTONYMS) - 1)
    a, b = _array([x for x, _ in ANTONYMS]), _array([y for _, y in ANTONYMS])
    k = F.pmod(i + j, F.lit(len(ANTONYMS)))
    return F.lit(""), _say("%s is to %s as %s is to what?", F.get(a, i), F.get(b, i), F.get(a, k)), F.get(b, k), b


@family
def define(d: Draw) -> Parts:
    i = d.number("i", 0, len(GLOSSES) - 1)
    return F.lit(""), _say("What is %s?", F.get(_array([a for a, _ in GLOSSES]), i)), F.get(_array([b for _, b in GLOSSES]), i), _array([b for _, b in GLOSSES])


@family
def knowledge(d: Draw) -> Parts:
    i = d.number("i", 0, len(KNOWN) - 1)
    return F.lit(""), F.get(_array([a for a, _ in KNOWN]), i), F.get(_array([b for _, b in KNOWN]), i), _array([b for _, b in KNOWN])


@family
def synonym(d: Draw) -> Parts:
    i = d.number("i", 0, len(SYNONYMS) - 1)
    return F.lit(""), _say("Which word means the same as %s?", F.get(_array([a for a, _ in SYNONYMS]), i)), F.get(_array([b for _, b in SYNONYMS]), i), _array([b for _, b in SYNONYMS])


@family
def antonym(d: Draw) -> Parts:
    i = d.number("i", 0, len(ANTONYMS) - 1)
    return F.lit(""), _say("Which word means the opposite of %s?", F.get(_array([a for a, _ in ANTONYMS]), i)), F.get(_array([b for _, b in ANTONYMS]), i), _array([b for _, b in ANTONYMS])


@family
def transitivity(d: Draw) -> Parts:
    p, i = d.order("people", PEOPLE), d.number("which", 0, 4)
    pairs = d.order("shown", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: _say("%s is taller than %s.", F.get(p, k), F.get(p, k + 1))))
    return F.array_join(pairs, " "), _say("Who is the %s tallest of the five?", F.get(_array(ORDINALS), i)), F.get(p, i), p


@family
def distribution(d: Draw) -> Parts:
    a, b, n = d.number("a", 1, 5), d.number("b", 1, 5), d.number("n", 20, 200)
    gold = F.floor(n * a / (a + b)).cast("long")
    return _say("%d coins are shared in the ratio %d to %d.", n, a, b), F.lit("How many whole coins does the first get?"), gold.cast("string"), _near(gold)


def rows(spark: SparkSession, name: str, n: int, seed: int = 7) -> DataFrame:
    """``n`` rows of a family: id, family, context, question, options, correct_index, teacher_probs, difficulty."""
    d = Draw(seed, name, F.col("row_no"))
    context, question, gold, wrong = FAMILIES[name](d)
    df = spark.range(n).withColumnRenamed("id", "row_no").select("row_no", context.alias("context"), question.alias("question"), gold.alias("gold"), wrong.alias("wrong"))
    pool = F.filter(F.array_distinct(d.order("options", F.col("wrong"))), lambda x: x.isNotNull() & ~x.eqNullSafe(F.col("gold")))
    free = F.col("gold").isNull()
    df = df.withColumn("wrong", F.slice(pool, F.lit(1), F.when(free, N_OPTIONS).otherwise(N_OPTIONS - 1)))
    asked = with_options(df.filter(~free), "gold", "wrong", seed, "row_no")
    open_ = df.filter(free).withColumn("options", F.col("wrong")).withColumn("correct_index", F.lit(None).cast("int"))
    out = asked.unionByName(open_) if name == "ambiguity" else asked
    return out.select(
        F.sha2(F.concat_ws("|", F.lit(name), F.lit(str(seed)), F.col("row_no").cast("string")), 256).alias("id"),
        F.lit(name).alias("family"),
        "row_no",
        "context",
        "question",
        "options",
        "correct_index",
        default_probs(F.size("options"), "correct_index").alias("teacher_probs"),
        F.lit("medium").alias("difficulty"),
    )


CHAINS = ("chain_arithmetic", "chain_logic", "chain_sequence", "chain_retrieval")


def chain_seeds(spark: SparkSession, name: str, n: int, seed: int = 7) -> DataFrame:
    """Seeds that a generated row must honour, with the answer they imply: (row_no, family, seed struct, expected)."""
    d = Draw(seed, name, F.col("row_no"))
    base = spark.range(n).withColumnRenamed("id", "row_no")
    if name == "chain_arithmetic":
        a, b, op = d.number("a", 9, 96), d.number("b", 2, 23), d.pick("op", ["add", "sub", "mul"])
        s = F.struct(a.alias("a"), b.alias("b"), op.alias("op"))
        expected = F.when(op == "add", a + b).when(op == "sub", a - b).otherwise(a * b).cast("string")
    elif name == "chain_logic":
        p = d.order("people", PEOPLE)
        s = F.struct(*[F.get(p, F.lit(i)).alias(x) for i, x in enumerate("xyz")])
        expected = F.get(p, F.lit(2))
    elif name == "chain_sequence":
        t, step = F.slice(d.order("things", THINGS), 1, 4), d.number("offset", 1, 3)
        s = F.struct(t.alias("items"), step.alias("offset"))
        expected = F.get(t, step)
    else:
        v, c, k = d.number("v", 24, 980), d.number("change", 0, 1), d.number("k", 2, 11)
        s = F.struct(v.alias("v"), F.when(c == 1, "add").otherwise("take").alias("change"), k.alias("k"))
        expected = F.when(c == 1, v + k).otherwise(v - k).cast("string")
    return base.select("row_no", F.lit(name).alias("family"), s.alias("seed"), expected.alias("expected"))


def seed_line(name: str, s: Column) -> Column:
    """The instruction that a seed adds to a prompt."""
    if name == "chain_arithmetic":
        return _say("Start from %d, apply %s with %d.", s["a"], s["op"], s["b"])
    if name == "chain_logic":
        return _say("If %s then %s; if %s then %s.", s["x"], s["y"], s["y"], s["z"])
    if name == "chain_sequence":
        return _say("Use the items %s in this order and ask for the one %d after the first.", F.array_join(s["items"], ", "), s["offset"])
    return _say("State the value %d, then %s %d.", s["v"], s["change"], s["k"])


def verified(name: str, text: Column, gold: Column, s: Column) -> Column:
    """The row names what its seed names, and its gold option is the implied answer."""
    digits = lambda n: F.array_contains(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), n.cast("string"))
    first = F.regexp_extract(gold, r"-?\d+", 0)
    if name == "chain_arithmetic":
        want = F.when(s["op"] == "add", s["a"] + s["b"]).when(s["op"] == "sub", s["a"] - s["b"]).otherwise(s["a"] * s["b"])
        return digits(s["a"]) & digits(s["b"]) & (first == want.cast("string"))
    if name == "chain_logic":
        return F.contains(text, s["x"]) & F.contains(text, s["y"]) & F.contains(gold, s["z"])
    if name == "chain_sequence":
        return F.forall(s["items"], lambda x: F.contains(text, x)) & F.contains(gold, F.get(s["items"], s["offset"]))
    want = F.when(s["change"] == "add", s["v"] + s["k"]).otherwise(s["v"] - s["k"])
    return digits(s["v"]) & digits(s["k"]) & (first == want.cast("string"))


FILLERS = ["The weather had been mild that week.", "Somebody had left a window open.", "A dog slept by the door.", "The tea had gone cold.", "A cart rolled by outside.", "The floor had just been swept."]


def noised(df: DataFrame, seed: int = 7, row_id: str = "id") -> DataFrame:
    """Rows with one to three fillers after the context: none that holds an option; rows without a usable one are left out.

    The id is new, and split_with keeps the row on its source's side.
    """
    from decisium.operators.validate import filler_ok

    d = Draw(seed, "noise", F.col(row_id))
    wanted = d.pick("n", [1, 1, 2, 2, 3])
    drawn = F.slice(d.order("fillers", FILLERS), 1, 3)
    usable = F.filter(drawn, lambda x: filler_ok(x, F.col("options")))
    df = df.withColumn("fillers", F.slice(usable, F.lit(1), wanted)).filter(F.size("fillers") > 0)
    df = df.withColumn("context", F.trim(F.concat_ws(" ", "context", F.array_join("fillers", " ")))).withColumn("noise_injected", F.size("fillers"))
    return df.withColumn("source_id", F.col(row_id)).withColumn(row_id, F.sha2(F.concat_ws("|", F.lit("noise"), F.col(row_id)), 256)).drop("fillers")
