import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm.pii import base_spans, candidates, find, learn, luhn, patterns, redact


def brute(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


@settings(max_examples=1500, deadline=None)
@given(st.text("a1@.- +(5é0%2", max_size=40))
def test_base_equals_brute_force(t):
    assert base_spans(t) == brute(t)


def test_base_on_made_texts():
    rng = random.Random(1)
    bits = ["4111 1111 1111 1111", "4111111111111112", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "+1 (555) 010-2030", "a.b@c.d.e", "x@y", "a@b@c.d", "éa@b.co", "12345678901234567890", " ", "-", ",", "@", "00.0001.2.3"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(6)))
        assert base_spans(t) == brute(t), t
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_bootstrap_finds_unseen(spark):
    hexa = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f'words here token = "{hexa(i)}" and more') for i in range(40)]
    rows += [(100, 'x token = "ZZ-9981-QQ" y'), (101, "plain 2024-11-05 date"), (102, None), (103, ""), (None, "mail a@b.co é"), (102, None), (104, "see 2024-11-06 date " * 3000)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, spans int")
    kept = learn(docs)
    got = {r.doc_id: r for r in find(docs, kept).collect()}
    assert got[100].spans == "id:11:21" and got[101].spans == "" and got[104].spans == ""
    assert got[3].spans.startswith("id:20:") and got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[None].n_email == 1 and got[None].spans == "email:5:11" and find(docs, kept).count() == len(rows)
    clean = {r.doc_id: r for r in redact(docs, kept).collect()}
    assert clean[100].text == 'x token = "<ID>" y' and clean[None].text == "mail <EMAIL> é" and clean[102].text is None and clean[101].text == rows[41][1]
    assert redact(docs, kept).columns == docs.columns
    none = docs.where("false")
    assert learn(none) == [] and find(none, []).count() == 0


def test_digest(spark):
    t = "+1 (555) 010-2030 a@b.co 1.2.3.4, 4111 1111 1111 1111"
    r = find(spark.createDataFrame([(1, t)], "doc_id long, text string"), []).first()
    want = ",".join(f"{k}:{a}:{e}" for k, a, e in brute(t))
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1) and r.spans == want and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_small_context_beside_a_hot_source(spark):
    hexa = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f"write to user{i}@mail.example now") for i in range(4000)]
    rows += [(5000 + i, f'badge = "{hexa(i)}" and more') for i in range(5)] + [(6000, 'badge = "ZZ-9981-QQ" y'), (6001, None), (None, 'badge = "ZZ-9982-QQ" y'), (6000, 'badge = "ZZ-9981-QQ" y')]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_chars int")
    kept = learn(docs)
    one = find(docs, kept)
    assert {r.spans for r in one.where("doc_id = 6000 or doc_id is null").collect()} == {"id:9:19"}
    # too many patterns to send: the same by joins
    many = learn(docs, send=0)
    assert sorted(r.pattern for r in many.collect()) == kept
    assert sorted(map(str, find(docs, many).collect())) == sorted(map(str, one.collect()))
    assert redact(docs, many).columns == docs.columns
    assert sorted(map(str, redact(docs, many).collect())) == sorted(map(str, redact(docs, kept).collect()))


def brute_patterns(texts, rounds=3, threshold=0.7, least=3):
    """The bootstrap over plain dictionaries."""
    import math

    links = {}
    for t in texts:
        t = t or ""
        base = base_spans(t)
        for a, e, s in [(a, e, True) for _, a, e in base] + [(a, e, bool(re.fullmatch(r"(?=[0-9]*[a-f])[0-9a-f]{16,}", t[a:e]))) for a, e in candidates(t, base)]:
            toks = [x.lower() for x in re.findall(r"[^\W\d_]+|[0-9]+|[^\w\s]|_", t[:a])][-2:]
            toks = ["^", "^", *toks][-2:]
            nxt = ([x.lower() for x in re.findall(r"[^\W\d_]+|[0-9]+|[^\w\s]|_", t[e:])][:1] or ["$"])[0]
            form = "".join("9" if c.isdigit() else "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else c for c in t[a:e])
            form = re.sub(r"(.)\1+", r"\1+", form)
            for p in (f"L2 {toks[0]} {toks[1]}", f"LR {toks[1]} {nxt}", f"LS {toks[1]} {form}"):
                links[p, t[a:e]] = links.get((p, t[a:e]), False) or s
    size = {}
    for p, _ in links:
        size[p] = size.get(p, 0) + 1
    held = {k: float(v) for k, v in links.items() if size[k[0]] >= least}
    sure = dict(held)
    for k in range(rounds):
        score = {p: sum(v for (q, _), v in sure.items() if q == p) / (size[p] + 1) for p, _ in held}
        if k == rounds - 1:
            break
        by = {}
        for p, i in held:
            by.setdefault(i, []).append(p)
        now = {i: max(max(held[p, i] for p in ps), 1 - math.prod(1 - min(0.9 * score[p], 0.99) for p in ps)) for i, ps in by.items()}
        sure = {(p, i): now[i] for p, i in held}
    return sorted(p for p, s in score.items() if s >= threshold)


def test_patterns_and_spans_equal_brute_force(spark):
    rng = random.Random(11)
    hexa = lambda: hashlib.sha1(str(rng.random()).encode()).hexdigest()
    forms = ['key = "{}" end', "id: {} .", "user {} said", "on {} we", "x" * 60 + " ref {} " + "y" * 70]
    things = [hexa, lambda: f"AB-{rng.randrange(10**6)}", lambda: f"2024-0{rng.randrange(1, 9)}-11", lambda: f"u{rng.randrange(99)}@mail.example", lambda: f"10.0.{rng.randrange(256)}.7"]
    texts = [" ".join(rng.choice(forms[: 3 + 2 * (i % 2)]).format(rng.choice(things)()) for _ in range(rng.randrange(1, 6))) for i in range(120)] + [None, "", "9" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = learn(docs)
    assert kept == brute_patterns(texts) and len(kept) > 5
    got = {r.doc_id: r.spans for r in find(docs, kept).collect()}
    for i, t in enumerate(texts):
        base = base_spans(t or "")
        own = [("id", a, e) for a, e in candidates(t or "", base) if set(patterns(t, a, e)) & set(kept)]
        assert got[i] == ",".join(f"{k}:{a}:{e}" for k, a, e in base + own)


def test_context_has_no_bound():
    t = "alpha " + "b" * 500 + " " * 300 + "ID-12345" + " " * 400 + "c" * 300
    a = t.index("ID-")
    assert patterns(t, a, a + 8) == [f"L2 alpha {'b' * 500}", f"LR {'b' * 500} {'c' * 300}", f"LS {'b' * 500} A+-9+"]
