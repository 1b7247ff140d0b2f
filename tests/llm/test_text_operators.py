import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skylode.llm import bpe, chat, dedup, licenses, packing, pii, secrets, simhash
from skylode.llm.queries import tokenizer

KIND = "doc_id long, text string, lang string, fp string, digest string"
ODD = ["", None, " ", "a", "ÄÖ ß é", "x" * 30000, "1" * 20000, "a@" * 3000, "word " * 4000, "🙂 中文 ΣΑΣ İ", "\x1c\x00 a", "<|endoftext|> token <|startoftext|>", "password = \n", "A", "a" * 17]


def docs(spark, texts, extra=()):
    """Rows with nulls, repeats and columns whose names the operators use themselves."""
    rows = [(i, t, "en", "1", "x") for i, t in enumerate([*texts, *ODD])] + [(3, texts[3] if len(texts) > 3 else "a", None, None, None), (None, "no id", "en", "1", "x"), (None, None, None, None, None), *extra]
    return spark.createDataFrame(rows, KIND)


def words(n, seed=1, vocabulary=400):
    r = random.Random(seed)
    stock = ["".join(r.choice("abcdeäö") for _ in range(r.randint(1, 8))) for _ in range(vocabulary)]
    return [" ".join(r.choice(stock) for _ in range(r.randint(0, 60))) for _ in range(n)]


# --- secrets ---------------------------------------------------------------


def plain_secrets(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 12:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_secrets_keep_the_base_and_equal_plain_patterns(spark):
    r = random.Random(3)
    parts = ["password", "token = ", "API_KEY: '", "apikey=", "secret", '"', " ", "=", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeefdeadbeef00", "é🙂", "\n\n", "x-y/z+12345678901", "ſecret=abcdefghijklmn", "user=bob", "host=db.example.com"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(300)]
    for row, text in zip(sorted(secrets.scan_secrets(docs(spark, texts).where("doc_id is not null").dropDuplicates(["doc_id"])).collect()), [*texts, *ODD], strict=True):
        assert row.base_sha256 == hashlib.sha256(plain_secrets(text or "").encode()).hexdigest(), text
        assert {*filter(None, plain_secrets(text or "").split(","))} <= {*row.spans.split(",")}


def test_weak_parts_need_a_complement():
    spans = lambda t: secrets.written(secrets.scan(t)[1])
    assert spans("user = bob and nothing else") == ""
    assert spans("pwd: hunter2x") == ""
    assert spans("user = bob\npwd: hunter2x") == "identifier:0:10,secret:11:24"
    assert spans("user = bob\n\npwd: hunter2x") == ""  # another scope
    assert spans("user = bob" + " " * 500 + "pwd: hunter2x") == ""  # too far
    assert spans("host=db.example.com user = bob") == ""  # no secret among them
    assert "endpoint" in spans("postgres://db.example.com/x pwd: hunter2x")


def test_redaction_keeps_columns(spark):
    d = docs(spark, ["token = '0123456789abcdef0' x", "plain"])
    out = secrets.redact_secrets(d)
    assert out.columns == d.columns and out.count() == d.count()
    assert out.where("doc_id = 0").first()["text"] == "[assign]' x"
    assert out.where("text is null").count() == d.where("text is null").count()


def test_weak_parts_reach_to_their_ends(spark):
    long = "k!" * 200
    cases = [f"host=db.example.com pwd: {long}", f"https://x.example.com/{'p/' * 300}?sig=tail pwd: hunter2x", f"user={'u.' * 150} pwd: hunter2x", f"host={'h.' * 150} pwd: hunter2x"]
    d = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    out = [r.text for r in secrets.redact_secrets(d).orderBy("doc_id").collect()]
    assert out == ["[endpoint] [secret]", "[endpoint] [secret]", "[identifier] [secret]", "[endpoint] [secret]"]
    assert secrets.written(secrets.scan(cases[0])[1]).endswith(f":{len(cases[0])}")


def test_the_rest_of_a_base_span_is_redacted(spark):
    cases = ["x password=abcdefghijkl!restOfIt y", "user=bob password=abcdefghijkl!restOfIt", "token=abcdefghijkl, then", "https://x.example.com/?token=abcdefghijkl&sig=!tail end", "password=abcdefghijkl\n\n!no"]
    d = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    out = [r.text for r in secrets.redact_secrets(d).orderBy("doc_id").collect()]
    assert out == ["x [assign] y", "[identifier] [assign]", "[assign] then", "[endpoint] end", "[assign]\n\n!no"]
    assert secrets.written(secrets.scan(cases[0])[1]) == "assign:2:23,secret:2:32"


# --- personal data ---------------------------------------------------------


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, digits[::-1])):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_pii(t):
    count = lambda s: sum(c.isdigit() for c in s)
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= count(m[0]) <= 19 and luhn(re.sub(r"\D", "", m[0]))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= count(m[0]) <= 15]
    return ",".join(f"{k}:{s}:{e}" for k, s, e in out)


def test_pii_equals_plain_patterns(spark):
    r = random.Random(5)
    parts = ["a.b", "@", "x-1.example", ".com", "é", "🙂", " ", "12", "300", ".", "007", "1.2.3.4", "+1 (017) 555-7713", "4539148803436467", "4539 1488 0343 6467", "-", "+", "_x", "\n", "0" * 18, "9807915762804490"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(400)]
    rows = pii.scan_pii(docs(spark, texts).where("doc_id is not null").dropDuplicates(["doc_id"])).orderBy("doc_id").collect()
    for row, text in zip(rows, [*texts, *ODD], strict=True):
        want = plain_pii(text or "")
        assert row.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), text
        assert {*filter(None, want.split(","))} <= {*row.spans.split(",")}


def test_pii_candidates_and_trees(spark):
    d = spark.createDataFrame([(1, "please mail bob [at] example [dot] com now"), (2, "phone: 555-123-4567 today"), (3, "version 12-34-56 of the build"), (4, "ssn 123-45-6789."), (5, "words only")], "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.scan_pii(d).collect()}
    assert found[1].startswith("email_like") and found[2].startswith("phone_like") and "id_like" in found[4]
    assert found[3] == "" and found[5] == ""
    x = np.array([[i % 7, i % 3] for i in range(400)])
    y = (x[:, 0] > 3).astype(float)
    assert ((pii.predict(pii.boost(x, y), x) > 0) == (y > 0)).all()
    assert pii.calibrated(np.array([3.0, 2.0, 1.0]), np.array([1, 1, 0]), 0.9) == 2.0
    assert pii.scan_pii(d.limit(0)).count() == 0


def test_a_span_dropped_for_another_drops_none_itself(spark, monkeypatch):
    chain = [(0, 10, 0.5), (8, 20, 0.7), (18, 30, 0.9), (40, 50, 0.5), (45, 55, 0.5)]

    own = [F.struct(F.lit(3).alias("o"), F.lit(s).cast("long").alias("s"), F.lit(e).cast("long").alias("e"), F.lit(p).alias("score")) for s, e, p in chain]
    monkeypatch.setattr(pii, "scored", lambda *_: F.array(*own))
    row = pii.scan_pii(spark.createDataFrame([(1, "x")], "doc_id long, text string")).first()
    assert (row.spans, row.n_selected) == ("id_like:0:10,id_like:18:30,id_like:40:50", 3)


def test_many_matches_in_one_text_are_found_in_order(spark):
    import time

    one = "write to a.b{0}@mail.example.com or +1 (609) 555-{0:04d} from 10.0.{1}.7, see x{0} at y dot com; "
    text = "".join(one.format(i, i % 256) for i in range(7000))
    d = spark.createDataFrame([(1, text, "x", 3)], "doc_id long, text string, row string, pii int")
    began = time.monotonic()
    row = pii.scan_pii(d).first()
    assert time.monotonic() - began < 60  # some seconds alone; a fold that copies a growing list takes minutes
    want = plain_pii(text)
    assert row.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and row.spans.startswith(want)
    assert (row.n_email, row.n_ip, row.n_phone) == (7000, 7000, 7000)
    kept = pii.with_spans(d, pii.train(spark=spark))
    assert kept.columns == ["doc_id", "text", "row", "pii"] and kept.first().row == "x"


def test_trees_in_sql_equal_trees_in_python(spark):
    model = pii.train(spark=spark)
    r = random.Random(4)
    x = [[r.randint(0, 24) for _ in pii.FEATURES] for _ in range(300)]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, f array<int>").select("i", pii._score(model.trees, F.col("f")).alias("s")).orderBy("i").collect()
    assert np.allclose([g.s for g in got], pii.predict(model.trees, np.array(x)))


def test_candidates_that_meet_base_spans_are_dropped(spark):
    r = random.Random(6)
    spans = lambda n: sorted([(s, s + r.randint(1, 9)) for s in r.sample(range(200), n)])
    cases = [(i, spans(r.randint(0, 6)), spans(r.randint(0, 9))) for i in range(60)]
    array = lambda own, w: [(s, w, e, w - 1, "", "", "") for s, e in own]
    d = spark.createDataFrame([(i, [(k, *b, "", "", "") for k, b in enumerate(base)], array(weak, 1)) for i, base, weak in cases], f"i int, base array<struct<kind:int,s:bigint,e:bigint,m:string,b:string,a:string>>, weak array<{pii.SPAN}>")
    got = {x.i: [(y.s, y.e) for y in x.free] for x in d.select("i", pii._free("base", "weak").alias("free")).collect()}
    assert got == {i: [w for w in weak if not any(b[0] < w[1] and w[0] < b[1] for b in base)] for i, base, weak in cases}


def test_corpus_candidates_are_labelled_by_the_base(spark):
    rows = [(i, f"word{i} from bob{i}@mail.example.com or at noon. Then call +1 (609) 555-{i:04d} now") for i in range(50)] + [(None, "a@b.cd"), (99, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.corpus_candidates(d).collect()
    assert {x.kind for x in got if x.y} == {"email_like", "phone_like"} and {x.kind for x in got if not x.y} == {"email_like"}
    assert pii.corpus_candidates(d, most=7).count() == 14 and pii.corpus_candidates(d.limit(0)).count() == 0
    assert pii.scan_pii(d, pii.train(d)).count() == 52


# --- exact duplicates ------------------------------------------------------


@pytest.mark.parametrize("digest", [None, lambda t: F.substring(F.sha2(t, 256), 1, 1)])
def test_exact_duplicates_equal_a_plain_grouping(spark, digest):
    texts = words(60) * 2 + ["Same Text", "same text", "SAME TEXT", "sÄme", "sämE", "SÄME"] + ["hot"] * 200
    d = docs(spark, texts)
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = defaultdict(list)
    for r in d.collect():
        groups[fold(r.text)].append(r.doc_id)
    out = (dedup.exact_duplicates(d, digest=digest) if digest else dedup.exact_duplicates(d)).collect()
    assert len(out) == d.count()
    want = sorted((str(i), str(max((x for x in ids if x is not None), default=None)), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in out) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in out)
    assert dedup.exact_duplicates(d.limit(0)).count() == 0


# --- preference pairs ------------------------------------------------------


def test_preference_pairs(spark):
    kind = "pair_id long, turn long, role string, text string, prompt string, k int"
    a = [(1, 0, "user", "hi", "x", 1), (1, 1, "assistant", "good", "x", 1), (2, 0, "user", None, "x", 1), (3, 0, "user", "é🙂", "x", 1), (3, 2, "assistant", "a", "x", 1), (3, 5, "user", "more", "x", 1), (None, 0, "user", "?", "x", 1), (4, 0, "user", "only", "x", 1)]
    b = [(1, 0, "user", "hi", "x", 1), (1, 1, "assistant", "bad", "x", 1), (1, 2, "user", "why", "x", 1), (2, 0, "user", "", "x", 1), (3, 0, "user", "é🙂", "x", 1), (3, 1, "assistant", "a", "x", 1), (5, None, None, "lost", "x", 1)]
    out = {r.pair_id: r for r in chat.preference_pairs(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind)).collect()}
    assert sorted(out) == [1, 2, 3, 4, 5]
    assert out[1].n_prompt_turns == 1 and out[1].prompt == "<|user|>\nhi\n" and out[1].chosen == "<|assistant|>\ngood\n" and out[1].rejected == "<|assistant|>\nbad\n<|user|>\nwhy\n"
    assert out[1].chosen[slice(*map(int, out[1].chosen_mask.split(":")))] == "good"
    assert (out[2].n_prompt_turns, out[2].chosen, out[2].rejected) == (1, "", "")
    assert out[3].n_prompt_turns == 2 and out[3].chosen == "<|user|>\nmore\n" and out[3].chosen_mask == "" and out[3].rejected == ""
    assert out[4].rejected is None and out[5].chosen is None and out[5].rejected == "<||>\nlost\n"
    empty = spark.createDataFrame([], kind)
    assert chat.preference_pairs(empty, empty).count() == 0


def test_preference_pairs_equal_sql(spark, tmp_path):
    r = random.Random(8)
    rows = [(c, t if r.random() < 0.97 else None, r.choice(["user", "assistant", "system", None]), r.choice(["a", "b", "é", None, ""])) for c in range(-20, 60) for t in range(r.randint(0, 9))]
    rows += [(7, 3, "assistant", "z")] * 3 + [(None, 1, "assistant", "lost")] + [(90, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(1200)] + [(91, 0, "assistant", "other")]
    spark.createDataFrame([(*x, "pair_id") for x in rows], "conv_id long, turn long, role string, text string, until string").coalesce(1).write.parquet(str(tmp_path / "c"))
    out = chat.preference_pairs(*chat.with_other_answers(spark.read.parquet(str(tmp_path / "c")))).collect()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    result = c.execute(chat.ORACLE)
    names = [x[0] for x in result.description]
    assert sorted(map(str, result.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in out)
    assert {r.n_prompt_turns for r in out} >= {0, 1, 2, 3, 4, 5, 1198} and sum(r.n_prompt_turns > 0 for r in out) > len(out) / 2
    assert chat.preference_pairs(*chat.with_other_answers(spark.read.parquet(str(tmp_path / "c")).limit(0))).count() == 0


# --- BPE -------------------------------------------------------------------


def test_bpe_equals_the_library_and_round_trips(spark):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    r = random.Random(4)
    pool = [chr(i) for i in range(256)] + list("ΣσςİǅＡ中🙂ﬁ½Ⅷ　 ​") + list("'stvemld") * 4 + [" "] * 30 + ["<|endoftext|>", "it's", "ABC"]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 30))) for _ in range(300)] + words(30)
    d = docs(spark, texts).where("doc_id is not null").dropDuplicates(["doc_id"])
    for row, text in zip(bpe.encode_documents(d, path).orderBy("doc_id").collect(), [*texts, *ODD], strict=True):
        ids = whole.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(row.ids), "<u4").tolist() == ids
        assert row.decoded == whole.decode(ids, skip_special_tokens=False)
    encoded = bpe.encode_documents(d, path)
    again = bpe.decode_documents(encoded.select("doc_id", "ids", F.lit(None).cast("string").alias("decoded")), path)
    assert again.columns == ["doc_id", "decoded"] and sorted(map(tuple, again.collect())) == sorted((x.doc_id, x.decoded) for x in encoded.collect())
    assert bpe.decode_documents(spark.createDataFrame([(None,)], "ids binary"), path).first().decoded == ""
    one = bpe.encode_digests(d.where("text = ''").limit(1), path).first()
    assert (one.n_tokens, one.ids_sha256) == (0, hashlib.sha256(b"").hexdigest())


def test_forced_cuts_lie_between_bytes_that_no_token_joins():
    e = bpe.ForcedBoundaryEncoder(open(tokenizer("word_bpe_49k.json"), encoding="utf-8").read())
    tokens = list(e.whole.get_vocab())
    pair = next(a + b for a in "qzxjv" for b in "qzxjv" if a + b not in e.joined) if any(a + b not in e.joined for a in "qzxjv" for b in "qzxjv") else None
    symbols = e.bytes_as[0x00] + e.bytes_as[0x01]
    for two in filter(None, (pair, symbols)):
        assert (two in e.joined) == any(two in t.removesuffix("</w>") for t in tokens)
    assert "".join(e.cuts("abc" + symbols + "de")) == "abc" + symbols + "de"
    assert len(e.cuts(symbols)) == 2


# --- packing ---------------------------------------------------------------


def test_packing_holds_every_token_once(spark):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    texts = words(150, vocabulary=50) + [" ".join(words(120, 9)), "<|endoftext|> x"]
    d = docs(spark, texts).where("doc_id is not null").dropDuplicates(["doc_id"]).repartition(2)
    rows = packing.pack_documents(d, path, window=3000, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert len(by_doc) == d.count()
    for i, text in enumerate([*texts, *ODD]):
        pieces = sorted(by_doc[i], key=lambda p: p.start)
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        assert [x for p in pieces for x in np.frombuffer(bytes(p.ids), "<u4")] == ids
        assert all(p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(bytes(p.ids)) for p in pieces)
    padded = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 2048 and {p.context for p in pieces} == {at if at & (at - 1) == 0 else 2048}
        padded += at & (at - 1) != 0
    assert padded <= 2  # one for each partition
    assert packing.pack_documents(d.limit(0), path).count() == 0


def test_steps_are_balanced():
    lengths = [2048] * 70 + [256] * 40 + [1024] * 9
    steps = packing.balanced(lengths, 16 * 2048)
    sums = defaultdict(int)
    for n, s in zip(lengths, steps, strict=True):
        sums[s] += n
    assert max(sums.values()) - min(sums.values()) <= 2048


# --- licenses --------------------------------------------------------------


def test_licenses_equal_brute_force(spark):
    r = random.Random(6)
    templates = licenses.TEMPLATES
    texts = []
    for i in range(200):
        body = words(1, i)[0].split()
        notice = r.choice(list(templates.values())).split()
        if r.random() < 0.4 and len(notice) > 9:
            notice[r.randrange(len(notice))] = "changed"
        at = r.randint(0, len(body))
        texts.append(" ".join([*body[:at], *(notice if r.random() < 0.7 else []), *body[at:]]))
    d = docs(spark, texts).where("doc_id is not null").dropDuplicates(["doc_id"])
    found = {(x.doc_id, x.license): round(x.containment, 6) for x in licenses.scan_licenses(d).collect()}
    tokens = lambda t: [w for w in (x.lower().strip(licenses._EDGE) for x in t.split()) if w]
    runs = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    want = {}
    for i, text in enumerate([*texts, *ODD]):
        own = runs(tokens(text or ""))
        for name, t in templates.items():
            goal = {*runs(tokens(t))}
            if len(goal.intersection(own)) < 0.8 * len(goal):
                continue
            width = 2 * len(goal) + 2
            best = max((len(goal.intersection(own[j : j + width])) / len(goal) for j in range(max(1, len(own)))), default=0)
            if best >= 0.8:
                want[i, name] = round(best, 6)
    assert found == want
    assert licenses.scan_licenses(d.limit(0)).count() == 0


def test_license_notices_in_a_row_are_counted(spark):
    notice, whole = licenses.TEMPLATES["gpl-3"], licenses.TEMPLATES["bsd-3-text"]
    texts = [" ".join([t] * n) for t in (notice, whole) for n in (1, 2, 3, 7)] + [f"{whole} {'other words stand here ' * 300} {whole}"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(x.doc_id, x.license): x.n_matches for x in licenses.scan_licenses(d).collect()}
    assert [found[i, "gpl-3"] for i in range(4)] == [1, 2, 3, 7]
    assert [found[i, "bsd-3-text"] for i in range(4, 9)] == [1, 2, 3, 7, 2]


def test_license_texts_with_many_changes_are_found_to_the_limit(spark):
    tokens = lambda t: [w for w in (x.lower().strip(licenses._EDGE) for x in t.split()) if w]
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    r, texts, want = random.Random(11), [], set()
    for i in range(300):
        name = r.choice(list(licenses.WHOLE))
        own = licenses.WHOLE[name].split()
        for at in r.sample(range(len(own)), r.randint(0, len(own) // 18)):
            own[at] = f"changed{at}"
        texts.append(" ".join(["before it"] * r.randint(0, 90) + own + ["after it"] * r.randint(0, 90)))
        goal = runs(tokens(licenses.WHOLE[name]))
        if len(goal & runs(tokens(" ".join(own)))) >= 0.8 * len(goal):
            want.add((i, name))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(x.doc_id, x.license) for x in licenses.scan_licenses(d).collect()}
    assert 100 < len(want) < 300 and want <= found


def test_bands_guarantee_collisions():
    assert licenses.bands_for(0.25) == 33 and 1 - (1 - 0.25) ** licenses.bands_for(0.25) >= 1 - licenses.MISS
    with pytest.raises(ValueError):
        licenses.Index({"short": "four words are few"})


# --- near duplicates -------------------------------------------------------


def plain_fingerprint(text, n=3):
    import xxhash

    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x]
    hashes = [xxhash.xxh64_intdigest(" ".join(s), 42) for s in zip(*(w[i:] for i in range(n)), strict=False)] or ([xxhash.xxh64_intdigest(" ".join(w), 42)] if w else [])
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("crowd", [512, 1])
def test_near_duplicates_equal_brute_force(spark, crowd):
    r = random.Random(7)
    texts = words(80, vocabulary=2000)
    for t in texts[:40]:
        w = t.split()
        if len(w) > 30:
            w[r.randrange(len(w))] = "other"
        texts.append(" ".join(w).upper())
    texts += ["same words here"] * 30
    d = docs(spark, texts)
    rows = d.collect()
    fps = [plain_fingerprint(x.text or "") for x in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                parent[root(i)] = root(j)
    least = defaultdict(lambda: None)
    for i, x in enumerate(rows):
        if x.doc_id is not None and (least[root(i)] is None or x.doc_id < least[root(i)]):
            least[root(i)] = x.doc_id
    want = sorted((str(x.doc_id), f"{fps[i]:016x}", str(least[root(i)])) for i, x in enumerate(rows))
    out = simhash.near_duplicates(d, crowd=crowd).select("doc_id", simhash.hex64().alias("h"), "component_id").collect()
    assert sorted((str(x.doc_id), x.h, str(x.component_id)) for x in out) == want


@pytest.mark.parametrize("crowd", [512, 2])
def test_links_connect_what_brute_force_connects(spark, crowd):
    from skylode.operators.graph import connected_components

    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(30)]
    fps = sorted({b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(8)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), crowd=crowd)
    label = {x.node: x.component for x in connected_components(links).collect()}
    near = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 2
    parent = {x: x for x in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if near(a, b):
                parent[root(a)] = root(b)
    for i, a in enumerate(signed):
        for b in signed[:i]:
            assert (root(a) == root(b)) == (label.get(a, a) == label.get(b, b))


def alike_groups(texts, words_=5, least=0.8):
    sets = [{tuple(w[i : i + words_]) for i in range(len(w) - words_ + 1)} or {tuple(w)} for w in ((t or "").lower().split() for t in texts)]
    return [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least]


@pytest.mark.parametrize("small", [64, 3])
def test_alike_texts_are_together_and_others_apart(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
    r = random.Random(3)
    stock = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    texts = [" ".join(r.choice(stock) for _ in range(r.randint(80, 300))) for _ in range(60)]
    for t in texts[:25]:
        for changes in (1, 2, 6):
            w = t.split()
            for _ in range(changes):
                w[r.randrange(len(w))] = "other"
            texts.append(" ".join(w))
    for _ in range(40):  # a large group around one text
        w = texts[30].split()
        w[r.randrange(len(w))] = r.choice(stock)
        texts.append(" ".join(w))
    d = docs(spark, texts)
    rows = d.collect()
    out = simhash.alike_documents(d).collect()
    assert len(out) == len(rows)
    label = {x.doc_id: x.component_id for x in out if x.doc_id is not None}
    links = alike_groups(texts, least=0.84)
    assert sum(label[i] == label[j] for i, j in links) >= 0.99 * len(links) and links
    apart = alike_groups(texts, least=0.3)
    grouped = {(i, j) for i in range(len(texts)) for j in range(i) if label[i] == label[j]}
    near = defaultdict(set)
    for i, j in apart:
        near[i].add(j)
        near[j].add(i)
    assert all(near[i] and near[j] for i, j in grouped)
    assert all(label[i] <= i for i in label)
    assert simhash.alike_documents(d.limit(0)).count() == 0


def grouped_alike(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {x.doc_id: x.component_id for x in simhash.alike_documents(d).collect()}


def test_copies_in_a_family_with_a_shared_passage_are_found(spark):
    r = random.Random(17)
    new = lambda n: ["".join(r.choice("abcdefgh") for _ in range(9)) for _ in range(n)]
    passage, texts = new(180), []
    for _ in range(500):  # alike by 0.56 through the passage, and each with a copy alike by 0.88
        shared = passage + new(54)
        texts += [" ".join(shared + new(16)), " ".join(shared + new(16))]
    label = grouped_alike(spark, texts)
    assert all(label[i] == label[i + 1] == i for i in range(0, 1000, 2))


def test_links_are_exact_at_the_similarity(spark):
    r = random.Random(18)
    new = lambda n: ["".join(r.choice("abcdefgh") for _ in range(9)) for _ in range(n)]
    passage, texts = new(300), []
    texts += [" ".join(passage + new(50)) for _ in range(120)]  # alike by 296 / 396, so 0.747
    over = len(texts)
    for _ in range(150):  # alike by 160 / 198, so 0.808
        shared = new(164)
        texts += [" ".join(shared + new(19)), " ".join(shared + new(19))]
    label = grouped_alike(spark, texts)
    assert all(label[i] == i for i in range(over))
    assert all(label[i] == label[i + 1] == i for i in range(over, len(texts), 2))
