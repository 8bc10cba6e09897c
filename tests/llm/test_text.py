"""Language ID, tokens, pseudonyms and chat formatting."""

import hashlib
import random
import re
import string
from datetime import date, datetime, timedelta

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tracewell.llm import bpe, chat, langid, pii
from tracewell.llm.common import word_count

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


# ---- language ID


def test_held_out_accuracy(spark):
    got = langid.op1_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    n, right = got.count(), got.where("lang_pred = lang").count()
    assert n > 20 and right >= 0.97 * n


def test_odd_texts(spark):
    rows = [(i, t, lang, "x") for i, (t, lang) in enumerate([("the cat and the dog went out", "en")] * 5 + [("el gato y el perro salieron", "es")] * 5)]
    odd = [(100, None, None, None), (101, "", "en", None), (102, "123 !!", None, "s"), (None, "the dog and the cat", "en", "s"), (103, "the dog " * 20_000, "en", "s"), (104, "日本語", None, "s")]
    docs = spark.createDataFrame(rows + odd + odd, "doc_id long, text string, lang string, lang_pred string")
    samples = langid.fit(docs, F.lit(True))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, samples).collect()}
    assert [got[i][0] for i in (100, 101, 102)] == ["und"] * 3 and got[100][1] == 0.0
    assert got[103][0] == got[None][0] == "en" and got[104][0] in ("en", "es") and 0.5 <= got[103][1] <= 1
    assert langid.identify(docs, samples).count() == docs.count()
    assert langid.identify(docs.limit(0), samples).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit(docs, F.lit(False))).collect()} == {"und"}


def plain_phrases(sample: list[int], text: list[int]) -> int:
    count, at = 0, 0
    s = ",".join(map(str, sample)) + ","
    while at < len(text):
        n = 0
        while at + n < len(text) and ("," + ",".join(map(str, text[at : at + n + 1])) + ",") in "," + s:
            n += 1
        count, at = count + 1, at + max(n, 1)
    return count


@pytest.mark.parametrize("segment", [4096, 16])
def test_phrases_against_plain_search(monkeypatch, segment):
    """Also over the cuts between segments."""
    monkeypatch.setattr(langid, "SEGMENT", segment)
    r = random.Random(5)
    samples = {k: "".join(r.choice(letters) for _ in range(300)) for k, letters in (("a", "abc "), ("b", "abd "))}
    m = langid.Model(samples)
    texts = [m.classes("".join(r.choice("abcdz ") for _ in range(r.randrange(1, 300))) + samples["a"][20:120]) for _ in range(20)]
    got = m.phrases(texts)
    for k, lang in enumerate(m.langs):
        seq = [langid.GAP, *m.classes(samples[lang]).tolist()]
        assert [plain_phrases(seq, t.tolist()) for t in texts] == got[:, k].tolist()


def test_many_languages_and_ties():
    """Thirty languages; equal samples cost the same, and the first name wins."""
    r = random.Random(17)
    samples = {f"l{i:02d}": "".join(chr(0x4E00 + 40 * i + r.randrange(60)) for _ in range(400)) for i in range(30)}
    m = langid.Model({**samples, "a": samples["l07"]})
    texts = [samples[k][50:90] for k in sorted(samples)]
    assert m.predict(texts)[0] == [k if k != "l07" else "a" for k in sorted(samples)]
    got = m.phrases([m.classes(t) for t in texts])
    for k, lang in enumerate(m.langs):
        full = samples["l07" if lang == "a" else lang]
        assert [plain_phrases([-1, *map(ord, full)], [*map(ord, t)]) for t in texts] == got[:, k].tolist()


@pytest.mark.parametrize("size, bits", [(600, 28), (20, 14)])
def test_large_alphabets_and_many_automata(monkeypatch, size, bits):
    """No letter of a sample is merged with another, and offsets may pass the dense table's."""
    monkeypatch.setattr(langid.Model, "BITS", bits)
    r = random.Random(16)
    draw = lambda first, n: "".join(chr(0x4E00 + first + r.randrange(size)) for _ in range(n))
    samples = {k: draw(i * size // 2, 2500) for i, k in enumerate("abc")}
    m = langid.Model(samples)
    texts = [draw(r.randrange(2 * size), 40) + samples["b"][i : i + 30] for i in range(10)] + [draw(0, 900)]
    got = m.phrases([m.classes(t) for t in texts])
    for k, lang in enumerate(m.langs):
        assert [plain_phrases([-1, *map(ord, samples[lang])], [*map(ord, t)]) for t in texts] == got[:, k].tolist()
    assert m.predict([t[:] for t in (samples["a"][50:99], samples["c"][7:60])])[0] == ["a", "c"]


# ---- byte-level BPE


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_ranks(RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tik(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.fst.ranks, special_tokens={})


def test_encoding_is_the_librarys(codec, tik):
    r = random.Random(1)
    letters = "aabcde  \n\t\x1c\x85 éß日本語'st1234😀!?​　%$" + "".join(chr(r.randrange(0x20, 0x3000)) for _ in range(40))
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(3000)] + ["", "a" * 5000, " " * 5000, "ab" * 3000, "\n" * 3000, "x<|endoftext|>y"]
    assert [codec.encode(t) for t in texts] == [tik.encode_ordinary(t) for t in texts]


def test_bounded_tables_change_nothing(codec, tik):
    small = bpe.Codec(codec.fst.ranks, public_tokenizers.PATTERN, (50, 20))
    texts = [d for d in ("Entlichung der éclairs, thatening 12 tokens", "more of the same, more") for _ in range(20)]
    assert [small.encode(t) for t in texts] == [tik.encode_ordinary(t) for t in texts]


def test_a_transition_is_built_when_it_was_missed_often(codec):
    fst, r = bpe.Transducer(codec.fst.ranks), random.Random(4)
    pieces = ["".join(r.choice("abeinrt é日") for _ in range(r.randrange(1, 14))).encode() for _ in range(400)]
    want = [tuple(codec.fst.ranks[t] for t in bpe.merge(codec.fst.ranks, p)) for p in pieces]
    assert [fst.encode(p) for p in pieces] == want and len(fst.go) < 100
    for _ in range(15 * bpe.MISSES):
        assert [fst.encode(p) for p in pieces] == want
    assert not fst.missed and len(fst.go) > 400
    few = bpe.Transducer(codec.fst.ranks, 40)
    for _ in range(2 * bpe.MISSES):
        assert [few.encode(p) for p in pieces] == want and len(few.missed) <= 10


def test_plain_merging_agrees_with_pairs(codec):
    r = random.Random(2)
    known = [i for i, t in codec.fst.bytes_of.items() if len(t) == 1 or bpe.merge(codec.fst.ranks, t) == [t]]
    for _ in range(3000):
        a, b = r.choice(known), r.choice(known)
        x, y = codec.fst.bytes_of[a], codec.fst.bytes_of[b]
        assert codec.fst.fits(a, b) == (bpe.merge(codec.fst.ranks, x + y) == [x, y])


def test_stream_decoder(codec):
    text = "naïve 日本語 😀 end"
    ids = codec.encode(text)
    for step in (1, 2, 3, 100):
        s = bpe.StreamDecoder(codec)
        assert "".join(s.feed(ids[i : i + step]) for i in range(0, len(ids), step)) + s.finish() == text
    one = {t: i for i, t in codec.fst.bytes_of.items() if len(t) == 1}
    r = random.Random(3)
    for _ in range(2000):
        data = bytes(r.choice([0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xED, 0xF0, 0x90, 0xF4, 0x8F, 0xFF]) for _ in range(r.randrange(8)))
        s = bpe.StreamDecoder(codec)
        assert "".join(s.feed([one[bytes([b])]]) for b in data) + s.finish() == data.decode("utf-8", "replace")


def test_encode_operator(spark, tik):
    docs = spark.createDataFrame([(1, "Hello wörld", 5), (None, None, 6), (2, "", 7), (2, "", 7), (3, "long " * 50_000, 8)], "doc_id long, text string, n_tokens int")
    got = bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 5 and by[1]["ids"] == tik.encode_ordinary("Hello wörld") and by[None]["n_tokens"] == 0
    assert by[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest() == by[2]["decoded_sha256"]
    assert by[3]["decoded_sha256"] == hashlib.sha256(b"long " * 50_000).hexdigest()
    back = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert {r["text"] for r in back.collect()} == {"Hello wörld", "", "long " * 50_000}
    assert bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


# ---- pseudonyms


def keyed(key, kind, i, x):
    return int(hashlib.sha256(f"{key}|{kind}|{i}|{x}".encode()).hexdigest()[:14], 16)


def permute(v, a, b, key, kind):
    left, right = divmod(v, b)
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            left = (left + keyed(key, kind, i, right)) % a
        else:
            right = (right + keyed(key, kind, i, left)) % b
    return left * b + right


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10


EARLY = [date(1800 + m // 12, m % 12 + 1, d) for m in range(4800) for d in range(1, 13)]
LATE = [x for n in range(146097) if (x := date(1800, 1, 1) + timedelta(n)).day > 12]
PLACES = {x: i for days in (EARLY, LATE) for i, x in enumerate(days)}


def moved_day(x, key):
    return EARLY[permute(PLACES[x], 240, 240, key, "date12")] if x.day <= 12 else LATE[permute(PLACES[x], 9, 9833, key, "date")]


def plain_mail(local, domain, key):
    sets = [string.digits, string.ascii_lowercase, string.ascii_uppercase]
    alive = [c for c in local if c in "".join(sets)]
    if len(alive) == 1:
        mine = next(s for s in sets if alive[0] in s)
        ranked = sorted(mine, key=lambda c: hashlib.sha256(f"{key}|letter|{ord(c)}|{domain}".encode()).hexdigest())
        return local.replace(alive[0], ranked[mine.index(alive[0])])
    halves = [local[: len(local) // 2], local[len(local) // 2 :]]
    for i in range(1, pii.ROUNDS + 1):
        z = bytes.fromhex(hashlib.sha256(f"{key}|email|{i}|{halves[1 - i % 2]}@{domain}".encode()).hexdigest())
        halves[i % 2] = "".join(next((s[(s.index(c) + z[j % 32]) % len(s)] for s in sets if c in s), c) for j, c in enumerate(halves[i % 2]))
    return "".join(halves)


CODES = [1, 7, 20, 27, 30, 31, 32, 33, 34, 36, 39, 40, 41, *range(43, 50), *range(51, 59), *range(60, 67), 81, 82, 84, 86, *range(90, 96), 98]


def plain_phone(m, key):
    d = re.sub(r"\D", "", m)
    code = "" if m[0] != "+" else next((d[:n] for n in (1, 2) if int(d[:n]) in CODES), d[:3])
    rest = d[len(code) :]
    if len(rest) == 10 and code in ("", "1"):
        first = 0 if rest[0] < "2" else 2
        v = permute(int(rest) - first * 10**9, 20_000 if not first else 80_000, 100_000, key, "phone01" if not first else "phone")
        rest = str(v + first * 10**9).zfill(10)
    else:
        h = len(rest) // 2
        rest = str(permute(int(rest), 10**h, 10 ** (len(rest) - h), key, "phone")).zfill(len(rest))
    out = iter(code + rest)
    return re.sub(r"\d", lambda _: next(out), m)


def plain_pseudonym(m, key):
    """A second implementation."""
    d = re.sub(r"\D", "", m)
    if "@" in m:
        local, domain = m.split("@")
        return f"{plain_mail(local, domain, key)}@{domain}"
    if re.fullmatch(pii.IPV4, m):
        o = list(map(int, m.split(".")))
        v = permute(((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3], 65536, 65536, key, "ip")
        return ".".join(str(v >> s & 255) for s in (24, 16, 8, 0))
    if re.fullmatch(pii.DATE, m):
        shape = "%Y-%m-%d" if m[4] == "-" else "%Y/%m/%d" if m[4] == "/" else "%d.%m.%Y" if "." in m else "%d/%m/%Y" if int(m[:2]) > 12 else "%m/%d/%Y"
        try:
            x = datetime.strptime(m, shape).date()
        except ValueError:
            return m
        return moved_day(x, key).strftime(shape) if x in PLACES else m
    if re.fullmatch(pii.PHONE, m):
        return plain_phone(m, key)
    if re.fullmatch(pii.SSN, m):
        a, g, s = map(int, m.split("-"))
        if a in (0, 666) or a >= 900 or not g or not s:
            return m
        v = permute(((a - (2 if a > 666 else 1)) * 99 + g - 1) * 9999 + s - 1, 88902, 9999, key, "ssn")
        a, g, s = v // (99 * 9999) + 1, v // 9999 % 99 + 1, v % 9999 + 1
        return f"{a + (a >= 666):03d}-{g:02d}-{s:04d}"
    if not re.match(pii.ISSUERS, d) or luhn(d):
        return m
    mid = d[2:-1]
    h = len(mid) // 2
    new = d[:2] + str(permute(int(mid), 10**h, 10 ** (len(mid) - h), key, "card")).zfill(len(mid)) + "0"
    out = iter(new[:-1] + str(-luhn(new) % 10))
    return re.sub(r"\d", lambda _: next(out), m)


def one(spark, texts, key="k"):
    """Also with columns of the names used inside."""
    df = spark.createDataFrame([(i, t, 9, "c", "d") for i, t in enumerate(texts)], "doc_id long, text string, n_pii int, __new string, __FOUND string")
    got = pii.pseudonymise(df, key).orderBy("doc_id").collect()
    assert all((r["__new"], r["__FOUND"]) == ("c", "d") for r in got)
    return [(r["text"], r["n_pii"]) for r in got]


def test_against_a_second_implementation(spark):
    r = random.Random(4)
    n = lambda k: "".join(str(r.randrange(10)) for _ in range(k))
    values = ["4111 1111 1111 1111", "4111-1111-1111-1111", "a@x.org", "b@x.org", "B7@x.org", "-.a@x.org", "+353 1234 5678", "+35312345678", "+44 20 7946 0958", "+7 912 345 6789", "29.02.2024", "28/02/1999", "02/29/2023"]
    for _ in range(30):
        d = r.choice(["4", "51", "37"]) + n(13)
        day = [f"{r.randrange(1790, 2210)}", f"{r.randrange(1, 14):02d}", f"{r.randrange(1, 32):02d}"]
        values += [d + str(-luhn(d + "0") % 10), d + "5", ".".join(str(r.randrange(300)) for _ in range(4)), "-".join(day), "/".join(day), ".".join(day[::-1]), "/".join(day[::-1]), "/".join([day[1], day[2], day[0]])]
        values += [f"+1 ({n(3)}) {n(3)}-{n(4)}", f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}.{n(3)}.{n(4)}", f"+{r.randrange(20, 99)} {n(3)} {n(4)}", f"{n(3)}-{n(2)}-{n(4)}"]
        values += ["".join(r.choice("abzAZ059._-") for _ in range(r.randrange(1, 50))) + "@mail.example.com"]
    assert plain_phone("+353 1234 5678", "k").replace(" ", "") == plain_phone("+35312345678", "k")
    checked = 0
    for value, (got, _) in zip(values, one(spark, [f"a {v} b" for v in values])):
        if re.fullmatch(pii.PATTERN.replace("{1,64}+", "{1,64}"), value):
            assert got == f"a {plain_pseudonym(value, 'k')} b", value
            checked += 1
    assert checked > 0.8 * len(values)


def test_each_small_domain_is_permuted(spark):
    """All dates, and all mailbox names of one character; numbers of different first digits stay apart."""
    days = spark.range(146097).selectExpr("date_add(date'1800-01-01', cast(id as int)) AS d").selectExpr("d", f"{pii.moved_date('d', 'k')} AS m")
    assert days.select("m").distinct().count() == 146097 and days.where("(day(d) <= 12) <> (day(m) <= 12) or m < '1800-01-01' or m > '2199-12-31'").count() == 0
    texts = [f"{d:02d}/{m:02d}/2024" for d in range(1, 32) for m in range(1, 32) if d <= 12 or m <= 12]
    got = [t for t, _ in one(spark, texts)]
    assert len(set(got)) == len(texts)
    names = [t for t, _ in one(spark, [f"{c}@x.org" for c in string.ascii_letters + string.digits])]
    assert len(set(names)) == 62 and len({(ord(n[0]) - ord(c)) % 26 for n, c in zip(names, string.ascii_lowercase)}) > 3
    phones = [f"({a}) 555-01{i:02d}" for a in ("012", "112", "212", "912") for i in range(100)]
    moved = [t for t, _ in one(spark, phones)]
    assert len(set(moved)) == 400 and all((a[1] < "2") == (b[1] < "2") for a, b in zip(phones, moved))


def test_keys(spark):
    df = spark.createDataFrame([(1, "10.0.0.1"), (1, "10.0.0.1")], "doc_id long, text string")
    with pytest.raises(ValueError):
        pii.pseudonymise(df, "")
    spark.conf.unset("spark.tracewell.pii.key")
    key = pii.secret(spark)
    assert len(key) == 32 and pii.secret(spark) == key and len({r.text for r in pii.pseudonymise(df, key).collect()}) == 1


def test_formats_and_links(spark):
    texts = ["call +1 (578) 555-6437 or (212) 555-0198", "mail Bob.Smith7@mail0.example.com.", "078-05-1120 is not 000-12-3456", "Bob.Smith7@mail0.example.com again", "2024-02-29 29.02.2024 02/29/2024 2024/02/29 29/02/2024", None, "", "12 and 3.14 of 1234567890123456", "x" * 300_000 + " 10.0.0.1"]
    got = one(spark, texts)
    assert re.fullmatch(r"call \+1 \([2-9]\d\d\) \d{3}-\d{4} or \([2-9]\d\d\) \d{3}-\d{4}", got[0][0]) and got[0][1] == 2 and got[0][0] != texts[0]
    new = re.search(r"\S+@mail0\.example\.com", got[1][0])[0]
    assert re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{4}\d@mail0\.example\.com", new) and got[3][0] == f"{new} again"
    assert re.fullmatch(r"\d{3}-\d\d-\d{4} is not 000-12-3456", got[2][0]) and got[2][1] == 1
    d = got[4][0].split()
    iso = d[0].split("-")
    assert d[1] == ".".join(iso[::-1]) and d[3] == "/".join(iso) and d[2] == "/".join([iso[1], iso[2], iso[0]]) and d[4] == "/".join(iso[::-1])
    assert got[5] == (None, 0) and got[6] == ("", 0) and got[7] == (texts[7], 0) and got[8][1] == 1
    assert one(spark, texts, "k") == got and one(spark, texts, "other")[1] != got[1]
    assert one(spark, []) == []


def test_network_is_a_permutation(spark):
    value = pii.feistel("id", "6L", "35L", "k", "t")
    assert sorted(r[0] for r in spark.range(210).selectExpr(f"{value} AS v").collect()) == list(range(210))
    same = pii.permuted_digits("lpad(cast(id as string), 3, '0')", "k", "t")
    assert len({r[0] for r in spark.range(1000).selectExpr(f"{same} AS v").collect()}) == 1000


def test_pii_plan_has_no_python(spark):
    plan = pii.op3_pii(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- chat


def test_escapes_are_reversible():
    r = random.Random(6)
    for _ in range(3000):
        t = "".join(r.choice(["<|", "<\\|", "<", "|", "\\", "im_end", "|>", "a", "\n"]) for _ in range(r.randrange(12)))
        assert "<|" not in chat.escape(t) and chat.unescape(chat.escape(t)) == t


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b <|im_end|>"), (1, 0, "user", "a"), (2, 0, "system", None), (2, 1, None, "x"), (None, 0, "assistant", "n"), (3, 0, "assistant", "é" * 100_000), (3, 0, "assistant", "dup"), (3, 0, "assistant", "dup")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part("text"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.render_turns(df)).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv, r in got.items():
        mine = sorted([x for x in rows if x[0] == conv], key=lambda x: (x[1], x[2] or "", x[3] or ""))
        turns = [(role or "", text or "") for _, _, role, text in mine]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.render_turns(df.limit(0))).count() == 0


def test_parts(spark):
    part = lambda kind, **k: {"type": kind, "text": None, "ref": None, "size": None, **k}
    turn, at, refs, tokens = chat.render("user", [part("text", text="see "), part("image", ref="s3://a", size=2), None, part("audio", ref="b"), part("document")])
    assert turn == "<|im_start|>user\nsee <|image:0|><|audio:1|><|document:2|><|im_end|>\n" and refs == ["s3://a", "b", ""] and tokens == [512, 25, 512]
    assert turn[at : -len(chat.END)].startswith("see ")
    with pytest.raises(ValueError):
        chat.render("user", [part("video")])


def test_word_count(spark):
    texts = [None, "", "  ", "a", " a\tb\x0bc\x0c d\r\ne\x1cf ", "é 日本  "]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(word_count("text")).collect()
    assert [r[0] for r in got] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
