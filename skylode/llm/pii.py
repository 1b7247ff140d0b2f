"""Personal data: fixed patterns, and weaker candidates that boosted trees select.

Everything over documents is DataFrame expressions inside one projection:
no shuffle, no Python. Only the trees are fitted on the driver, from
bounded samples whose features the same expressions compute.
"""

from __future__ import annotations

import math
import random
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skylode.llm.common import free_name, let, scanned

#: The base patterns. Possessive forms match the same texts as greedy ones
#: here, as what follows a run is never part of it; and a run is entered at its start (or where the last match ended) alone.
#: Runs of digits that are too short for a card fail in any case, so the pattern asks for 16.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators of weaker candidates. They may overlap each other and the base.
GENERATORS = {
    "email_like": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?(?:\[at\]|\(at\)|@|\x20at\x20)\x20?[a-z0-9-]{1,63}+(?:\x20?(?:\[dot\]|\(dot\)|\.|\x20dot\x20)\x20?[a-z0-9-]{2,24}+){1,3}+",
    "phone_like": r"(?<![0-9.+])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20./-]{1,2}[0-9]{2,5}){2,4}+(?![0-9])",
    "card_like": r"(?<![0-9])[0-9]{4}(?:[\x20./-]{1,2}[0-9]{2,7}){2,4}+(?![0-9])",
    "id_like": r"(?<![0-9A-Za-z])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9A-Za-z])",
}
CUES = {
    "email_like": "mail|contact|write|reach",
    "phone_like": "phone|tel|call|mobile|cell|fax",
    "card_like": "card|visa|mastercard|amex|credit|debit|pay",
    "id_like": "ssn|social|security|identity|passport|national",
}
#: Ends of host names, and words that speak against a candidate.
ENDINGS = "com|org|net|edu|gov|info|io|co|de|fr|es|uk"
AGAINST = "order|invoice|version|isbn|page|serial|build|model|ref|sku|batch|part"
#: Synthetic candidates that the trees are fitted and calibrated on, as many of each label from the corpus at most, and documents that these come from.
SAMPLE, DOCUMENTS = 3000, 4000
#: The precision that thresholds are set for, and the shape of the trees.
PRECISION, TREES, DEPTH, RATE = 0.97, 24, 3, 0.3
#: Candidates that each side of a split has at least.
LEAST = 10
FEATURES = ("kind", "digits", "length", "runs", "luhn", "cue", "against", "joined_before", "joined_after", "distinct", "marks", "at", "ending", "sentence")
_BEFORE, _AFTER = 28, 6
HIT = "struct<s:bigint,e:bigint,m:string,b:string,a:string>"
SPAN = "struct<s:bigint,w:int,e:bigint,o:int,m:string,b:string,a:string>"


class Model(NamedTuple):
    """Boosted trees (a base score and the trees), and for each generator the least score that selects."""

    trees: tuple[float, list]
    thresholds: dict[str, float]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.call_function("substring", digits, n - i, F.lit(1)).cast("int") * (F.lit(1) + i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def found(text: str, pattern: str) -> Column:
    """Array of (s, e, m, b, a): start and end in code points and text of each leftmost non-overlapping match, and what stands before and after it, up to the next match.

    The pieces between matches and the matches themselves have the lengths that add up to offsets, and hold the surroundings: nothing is
    counted from the text's start again, so the cost is that of reading the text.
    """
    begins, none = "(s_.state + length(x.g))", f"cast(array() as array<{HIT}>)"
    ends = f"({begins} + length(x.m))"
    two = f"named_struct('m', regexp_extract_all({text}, r'{pattern}', 0), 'g', split({text}, r'{pattern}', -1))"
    steps = f"""zip_with(zip_with(slice(two.g, 1, size(two.m)), two.m, (g, m) -> named_struct('g', g, 'm', m)), slice(two.g, 2, size(two.m)),
        (y, n) -> named_struct('g', y.g, 'm', y.m, 'a', substring(n, 1, {_AFTER})))"""
    hit = f"named_struct('s', {begins}, 'e', {ends}, 'm', x.m, 'b', substring(x.g, -{_BEFORE}, {_BEFORE}), 'a', x.a)"
    return F.expr(let(two, "two", f"if(size(two.m) > 0, {scanned(steps, '0L', ends, hit, HIT)}.out, {none})"))


def _valid(kind: str, m: Column) -> Column:
    count = F.length(_digits(m))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        short = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(short, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= F.lit("255"))))
    if kind == "card":
        return count.between(16, 19) & _luhn(_digits(m))
    return count.between(8, 15)


def _features(number: Column, m: Column, before: Column, after: Column) -> Column:
    """The features of a candidate as an array of whole numbers, in the order of FEATURES; ``number`` is its generator's place."""
    digits = _digits(m)
    cue = F.lit(False)
    for i, kind in enumerate(GENERATORS):
        cue = F.when(number == i, F.lower(before).rlike(CUES[kind])).otherwise(cue)
    values = {
        "kind": number,
        "digits": F.length(digits),
        "length": F.length(m),
        "runs": F.size(F.split(F.regexp_replace(m, "[^0-9]+", " "), " ")),
        "luhn": (F.length(digits) >= 12) & _luhn(digits),
        "cue": cue,
        "against": F.lower(before).rlike(AGAINST),
        "joined_before": before.rlike(r"[\p{L}0-9_./-]$"),
        "joined_after": after.rlike(r"^[\p{L}0-9_%/$€-]"),
        "distinct": F.size(F.array_distinct(F.split(digits, ""))),
        "marks": F.size(F.array_distinct(F.split(F.regexp_replace(m, "[0-9A-Za-z]", ""), ""))),
        "at": F.lower(m).rlike(r"@|\[at\]|\(at\)"),
        "ending": F.lower(m).rlike(rf"(?:[. ]|dot[\])]) ?(?:{ENDINGS})$"),
        "sentence": m.rlike(r"[.] |[.]\p{Lu}"),
    }
    return F.array(*[F.coalesce(values[f].cast("int"), F.lit(0)) for f in FEATURES])


# --- the trees -------------------------------------------------------------


def synthetic(count: int = SAMPLE, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """(kind, match, before, after, label): candidates made by rule, personal and not, with and without context."""
    r = random.Random(seed)
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))
    cue = {"email_like": "please mail ", "phone_like": "phone: ", "card_like": "visa card ", "id_like": "ssn "}
    rows = []
    for _ in range(count):
        kind, real = r.choice(tuple(GENERATORS)), r.random() < 0.5
        sep = r.choice(" -.")
        if kind == "email_like":
            at = r.choice(["[at]", " [at] ", "(at)", "@", " at "]) if real else r.choice([" at ", " at ", "@"])
            dot = r.choice(["[dot]", " dot ", "."]) if real and at != " at " else " dot " if real else r.choice([".", ". ", ". ", " dot "])
            last = r.choice(ENDINGS.split("|")) if real else word()[: r.randint(2, 8)].ljust(2, "n")
            m = f"{word()}{at}{word()}{dot}{last.capitalize() if dot == '. ' else last}"
        elif kind == "phone_like":
            m = sep.join([f"({number(3)})" if r.random() < 0.4 else number(3), number(3), number(4)]) if real else sep.join([number(r.choice([2, 4])), number(2), number(r.choice([2, 4]))])
        elif kind == "card_like":
            body = r.choice("3456") + number(14)
            total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, body)))
            body += str(-total % 10)
            body = body if real else body[:-1] + str((int(body[-1]) + r.randint(1, 9)) % 10)
            m = sep.join(body[i : i + 4] for i in range(0, 16, 4))
        else:
            m = f"{number(3)}-{number(2)}-{number(4)}"
        hint = r.random()
        before = (cue[kind] if hint < 0.7 else word() + " ") if real else (r.choice(AGAINST.split("|")) + " " if hint < 0.7 else word() + " ")
        before += "" if r.random() < 0.9 or real else r.choice(["x", "/", "-"])
        after = r.choice([" ", ".", ",", ""]) if real or r.random() < 0.6 else r.choice(["%", "-7", "/a"])
        rows.append((kind, m, f"{word()} {before}"[-_BEFORE:], after, int(real)))
    return rows


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> tuple[float, list]:
    """Gradient boosting of the logistic loss: a base score, and trees of (feature, threshold, low side, high side) or leaf values."""
    rate0 = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    score = np.full(len(y), math.log(rate0 / (1 - rate0)))
    base, out = float(score[0]), []

    # Each feature's values by place in their order, so that a node's sums over them are one count and one running sum.
    levels = [np.unique(x[:, f], return_inverse=True) for f in range(x.shape[1])]

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, float]:
        """The best gain, feature and threshold of a node."""
        best = (1e-6, -1, 0.0)
        whole_g, whole_h = g[rows].sum(), h[rows].sum()
        for f, (values, place) in enumerate(levels):
            own = place[rows]
            low_n, low_g, low_h = (np.cumsum(np.bincount(own, w, len(values)))[:-1] for w in (None, g[rows], h[rows]))
            gain = low_g**2 / (low_h + 1.0) + (whole_g - low_g) ** 2 / (whole_h - low_h + 1.0) - whole_g**2 / (whole_h + 1.0)
            gain[np.minimum(low_n, len(rows) - low_n) < LEAST] = 0
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), f, float(values[gain.argmax() + 1]))
        return best

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        gain, f, cut = split(rows, g, h) if left else (0.0, -1, 0.0)
        if f < 0:
            value = float(rate * g[rows].sum() / (h[rows].sum() + 1.0))
            score[rows] += value
            return value
        low = x[rows, f] < cut
        return (f, cut, grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        out.append(grow(np.arange(len(y)), y - p, p * (1 - p), depth))
    return base, out


def predict(model: tuple[float, list], x: np.ndarray) -> np.ndarray:
    def walk(tree, row) -> float:
        while isinstance(tree, tuple):
            tree = tree[3] if row[tree[0]] >= tree[1] else tree[2]
        return tree

    return np.array([model[0] + sum(walk(t, row) for t in model[1]) for row in x])


def _complete(tree, depth: int, default: float = 0.0) -> tuple[list[int], list[float], list[float]]:
    """A tree as one of full depth, level by level: features, thresholds (infinite where nothing is asked) and leaves."""
    level, places, cuts = [tree], [], []
    for _ in range(depth):
        places += [t[0] if isinstance(t, tuple) else 0 for t in level]
        cuts += [t[1] if isinstance(t, tuple) else math.inf for t in level]
        level = [side for t in level for side in ((t[2], t[3]) if isinstance(t, tuple) else (t, t))]
    return places, cuts, level


def _score(model: tuple[float, list], features: Column, depth: int = DEPTH) -> Column:
    """A fold over the trees, which are one constant array; each asks the features by place."""
    number = lambda x: "double('inf')" if x == math.inf else f"{x!r}D"
    listed = lambda values, show: f"array({','.join(map(show, values))})"
    trees = [_complete(t, depth) for t in model[1]]
    constant = F.expr(listed(trees, lambda t: f"named_struct('f',{listed(t[0], str)},'c',{listed(t[1], number)},'v',{listed(t[2], number)})"))

    def walk(total: Column, tree: Column) -> Column:
        at = F.lit(0)
        for level in range(depth):
            node = F.lit((1 << level) - 1) + at
            at = at * 2 + (F.get(features, F.get(tree["f"], node)) >= F.get(tree["c"], node)).cast("int")
        return total + F.get(tree["v"], at)

    return F.aggregate(constant, F.lit(float(model[0])), walk)


def calibrated(scores: np.ndarray, labels: np.ndarray, precision: float = PRECISION) -> float:
    """The lowest score from which on held-out candidates are personal data at this share; infinite if none."""
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(labels[order]) / np.arange(1, len(order) + 1)
    last = np.append(scores[order][1:] != scores[order][:-1], True) if len(order) else np.zeros(0, bool)  # ties go together
    good = np.flatnonzero((right >= precision) & last)
    return float(scores[order][good[-1]]) if len(good) else math.inf


#: Rows of candidates, for the fit and for what is found.
_KIND = "kind string, m string, b string, a string, y int"


def _disguised(kind: Column, m: Column, by: Column) -> Column:
    """Rows (kind, m) that base matches become when they are written in a weaker form; ``by`` chooses which."""
    pick = lambda *forms: F.element_at(F.array(*map(F.lit, forms)), (F.pmod(by, F.lit(len(forms))) + 1).cast("int"))
    mail = F.regexp_replace(F.replace(m, F.lit("@"), pick(" at ", "[at]", " [at] ", "(at)")), F.lit(r"\.(?=[^.]*$)"), pick(" dot ", "[dot]", "."))
    cards = F.regexp_replace(F.regexp_replace(_digits(m), "([0-9]{4})(?=[0-9])", "$1_"), "_", pick(" ", "-", "."))
    phone = F.regexp_replace(m, r"^\+[0-9]{1,3}[ .-]?", "")
    return F.when(kind == "email", F.struct(F.lit("email_like").alias("kind"), mail.alias("m"))).when(kind == "card", F.struct(F.lit("card_like").alias("kind"), cards.alias("m"))).when(kind == "phone", F.struct(F.lit("phone_like").alias("kind"), phone.alias("m")))


def corpus_candidates(docs: DataFrame, documents: int = DOCUMENTS, most: int = SAMPLE) -> DataFrame:
    """Rows (kind, m, b, a, y) of candidates with weak labels from ``documents`` documents, chosen by a hash of doc_id, and ``most`` candidates of each label by hash.

    Personal data is what the base patterns find, written in a weaker form where it stands (1); what the generators propose outside base spans counts as not personal (0).
    """
    chosen = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(documents)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), "id", "left_semi")  # so many ids at most
    held = rows.select(*_hits("coalesce(text, '')"))
    base = held.select(F.explode("base").alias("x")).select("x.*")
    turned = _disguised(F.col("kind"), F.col("m"), F.xxhash64("m"))
    whole = F.lit(False)
    for kind, pattern in GENERATORS.items():
        whole = whole | ((F.col("t.kind") == kind) & F.regexp_like("t.m", F.lit(f"^(?:{pattern})$")))
    personal = base.withColumn("t", turned).where(whole).select("t.kind", "t.m", "b", "a", F.lit(1).alias("y"))
    free = held.select(F.explode(_free("base", "weak")).alias("x"))
    others = free.select(F.element_at(F.array(*map(F.lit, GENERATORS)), F.col("x.o") + 1).alias("kind"), "x.m", "x.b", "x.a", F.lit(0).alias("y"))
    some = lambda df: df.orderBy(F.xxhash64("kind", "m", "b", "a"), "kind", "m", "b", "a").limit(most)
    return some(personal).unionByName(some(others))


def fitted(spark: SparkSession, candidates: list[tuple], seed: int = 11) -> Model:
    """Trees from one half of the candidates (kind, m, b, a, y), and a threshold for each kind from the other. Their features are computed by the expressions that scan texts."""
    kinds = list(GENERATORS)
    rows = sorted(candidates)
    random.Random(seed).shuffle(rows)
    numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"n int, {_KIND}")
    number = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")).cast("int") - 1
    got = numbered.select("n", "y", "kind", _features(number, F.col("m"), F.col("b"), F.col("a")).alias("f")).orderBy("n").collect()  # as many rows as there are candidates
    x, y = np.array([r.f for r in got]).reshape(-1, len(FEATURES)), np.array([r.y for r in got], float)
    trees = boost(x[::2], y[::2])
    scores, held = predict(trees, x[1::2]), np.array([r.kind for r in got])[1::2]
    return Model(trees, {k: calibrated(scores[held == k], y[1::2][held == k]) for k in kinds})


def train(docs: DataFrame | None = None, spark: SparkSession | None = None) -> Model:
    """Trees and thresholds from synthetic candidates (SAMPLE) and, given ``docs``, those of a bounded sample of its documents (:func:`corpus_candidates`)."""
    spark = docs.sparkSession if docs is not None else spark or SparkSession.active()
    own = [] if docs is None else [tuple(r) for r in corpus_candidates(docs).collect()]  # 2 * SAMPLE rows at most
    return fitted(spark, [*synthetic(), *own])


# --- the operator ----------------------------------------------------------


def _hits(text: str) -> tuple[Column, Column]:
    """Columns base, array of (kind, s, e, m, b, a), by kind and start, and weak, an array of (s, w, e, o, m, b, a) with the generator's place o, of a text in SQL.

    Cheap tests, which every match passes, spare most texts the patterns.
    """
    t = F.expr(text)
    needs = {"email": t.contains("@"), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike(r"[0-9](?:[ -]?[0-9]){15}"), "phone": t.contains("+")}
    mail = r"(?i)@|\[at\]|\(at\)| at  ?[a-z0-9-]{1,63} ?(?:[\[(]dot|\.| dot )"
    near = {"email_like": t.rlike(mail), "phone_like": t.rlike(r"[0-9)][ ./-]{1,2}[0-9]"), "card_like": t.rlike(r"[0-9]{4}[ ./-]{1,2}[0-9]{2}"), "id_like": t.rlike(r"[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}")}
    none = F.expr(f"cast(array() as array<{HIT}>)")

    def fixed(kind: str) -> Column:
        hits = F.filter(F.when(needs[kind], found(text, PATTERNS[kind])).otherwise(none), lambda x: _valid(kind, x["m"]))
        return F.transform(hits, lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), x["b"].alias("b"), x["a"].alias("a")))

    def proposed(number: int, kind: str) -> Column:
        hits = F.when(near[kind], found(text, GENERATORS[kind])).otherwise(none)
        return F.transform(hits, lambda x: F.struct(x["s"].alias("s"), F.lit(1).alias("w"), x["e"].alias("e"), F.lit(number).alias("o"), x["m"].alias("m"), x["b"].alias("b"), x["a"].alias("a")))

    base, weak = [fixed(kind) for kind in PATTERNS], [proposed(i, kind) for i, kind in enumerate(GENERATORS)]
    return F.concat(*base).alias("base"), F.concat(*weak).alias("weak")


def _free(base: str, weak: str) -> Column:
    """The candidates that overlap no base span, by start: two passes over all spans in order, one for those that begin before a candidate's end and one for those after."""
    fixed = f"transform({base}, y -> named_struct('s', y.s, 'w', 0, 'e', y.e, 'o', -1, 'm', '', 'b', '', 'a', ''))"
    before = scanned(f"sort_array(concat({fixed}, {weak}))", "-1L", "if(x.w = 0, greatest(s_.state, x.e), s_.state)", "if(x.w = 0 or s_.state <= x.s, x, null)", SPAN)
    after = scanned(f"reverse(filter({before}.out, y -> y is not null))", "1L << 60", "if(x.w = 0, x.s, s_.state)", "if(x.w = 1 and x.e <= s_.state, x, null)", SPAN)
    return F.expr(f"if(size({weak}) > 0, reverse(filter({after}.out, y -> y is not null)), {weak})")


def scored(free: Column, model: Model) -> Column:
    """Array of (o, s, e, score), by start: the candidates whose score reaches their kind's threshold. Features are made once, then asked by the trees."""
    told = F.transform(free, lambda x: F.struct(x["o"].alias("o"), x["s"].alias("s"), x["e"].alias("e"), _features(x["o"], x["m"], x["b"], x["a"]).alias("f")))
    rated = F.transform(told, lambda x: F.struct(x["o"].alias("o"), x["s"].alias("s"), x["e"].alias("e"), _score(model.trees, x["f"]).alias("score")))
    limits = F.array(*[F.lit(float(model.thresholds[k])) for k in GENERATORS])
    return F.filter(rated, lambda x: x["score"] >= F.get(limits, x["o"]))


def _best(spans: str) -> Column:
    """Of (o, s, e, score), by start, those that stay: the best first, each that overlaps none that stays already (the earlier kind, then the earlier start, at a tie).

    Runs of spans that overlap each other are chosen from one by one, so the cost is quadratic in a run, not in the text.
    """
    kind = "struct<o:int,s:bigint,e:bigint,score:double>"
    step = "named_struct('until', greatest(s_.state.until, x.e), 'run', if(x.s < s_.state.until, concat(s_.state.run, array(x)), array(x)))"
    runs = scanned(spans, f"named_struct('until', -1L, 'run', cast(array() as array<{kind}>))", step, "if(x.s >= s_.state.until, s_.state.run, null)", f"array<{kind}>")
    every = f"filter({let(runs, 'all', 'concat(all.out, array(all.state.run))')}, y -> y is not null)"
    ranked = "sort_array(transform(run, y -> named_struct('r', -y.score, 'o', y.o, 's', y.s, 'e', y.e)))"
    kept = f"aggregate({ranked}, cast(array() as array<struct<r:double,o:int,s:bigint,e:bigint>>), (done, y) -> if(exists(done, k -> k.s < y.e and y.s < k.e), done, concat(done, array(y))))"
    chosen = f"transform({kept}, y -> named_struct('o', y.o, 's', y.s, 'e', y.e, 'score', -y.r))"
    return F.expr(f"if(size({spans}) > 1, flatten(transform({every}, run -> if(size(run) > 1, {chosen}, run))), {spans})")


def with_spans(docs: DataFrame, model: Model, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with an array of (kind, s, e, base) in column ``into``: base spans by kind and start, then selected candidates, by kind and start too.

    A candidate that overlaps a base span is dropped; of overlapping candidates that reach their thresholds see :func:`_best`. Other columns stay as they are,
    whatever their names; a column named ``into`` is replaced.
    """
    row, kinds = free_name(docs, "row"), F.array(*map(F.lit, GENERATORS))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), *_hits(f"coalesce(`{text}`, '')"))
    held = held.select(row, "base", scored(_free("base", "weak"), model).alias("fine"))
    held = held.select(row, "base", F.sort_array(F.transform(_best("fine"), lambda x: F.struct(x["o"], x["s"], x["e"]))).alias("kept"))
    span = lambda kind, x, base: F.struct(kind.alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lit(base).alias("base"))
    whole = F.concat(F.transform("base", lambda x: span(x["kind"], x, True)), F.transform("kept", lambda x: span(F.element_at(kinds, x["o"] + 1), x, False)))
    return held.select(*[F.col(f"{row}.`{c}`") for c in docs.columns if c != into], whole.alias(into))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan_pii(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_selected), one for each row of ``docs``.

    Offsets count code points, ends exclusive. Null texts count as empty ones, which
    have no spans. Very long texts cost in proportion to their length and matches. Repeated rows are scanned each, a null doc_id is kept, an empty
    table gives no rows, other columns are not read. Without a ``model`` (:func:`train`) one is fitted on synthetic candidates alone.
    """
    model = model or train(spark=docs.sparkSession)
    rows = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda x: x["base"])
    return rows.select("doc_id", *map(count, PATTERNS), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("pii")).alias("spans"), F.size(F.filter("pii", lambda x: ~x["base"])).cast("long").alias("n_selected"))
