import hashlib
import math
import random
import re
from collections import Counter

from pulseloom.llm import secrets

from . import edge


def brute(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), m.end(), 0))
    out += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


TRICKY = [
    "AKIAAKIA" + "A" * 14 + " xAKIA" + "B" * 15 + " AKIA" + "9" * 30,
    "pASSword=abc token : 'deadbeef' ſecret=abcdefg toKen=abcdefg api-key=abcdefg APIkey==abc passwd='\"abcdef",
    "zz" + "0123456789abcdef" * 2 + "gg" + "a" * 23 + " " + "f" * 24,
    "é🙂 secret=ééé secret=abcdef🙂",
]


def test_base_spans():
    for t in [t or "" for _, t, _ in edge.TEXTS] + TRICKY:
        assert secrets.base_spans(t) == brute(t), t


def test_query_digest(spark):
    got = {r.doc_id: r for r in secrets.op3_grammar_secrets(spark, edge.SF).collect()}
    for r in edge.sf_docs(spark).collect():
        want = brute(r.text)
        x = got[r.doc_id]
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(b[2] == k for b in want) for k in range(3))
        listed = secrets.written(want)
        assert x.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) <= set(x.spans.split(",")) | {""}


def random_words(seed, n, alphabet, low, high=None):
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randrange(low, (high or low) + 1))) for _ in range(n)]


def reachable(a):
    met, todo = {0}, [0]
    while todo:
        for t in a.next[todo.pop()].values():
            if t not in met:
                met.add(t)
                todo.append(t)
    return len(met)


HEX = "0123456789abcdef"
ALNUM = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def test_automaton_keeps_lengths_and_prefixes():
    for n in (75, 750):
        a = secrets.Automaton(random_words(n, n, HEX, 40))
        assert reachable(a) == len(a.next) == 41
        for w in random_words(5, 20, HEX, 41):
            right = a.bits(w[:40])
            # One character fewer or more costs at least six bits beyond the characters themselves.
            assert a.bits(w[:39]) < right - 6 and a.bits(w) < right - 6
    mixed = random_words(1, 400, HEX, 18) + ["sk_live_" + w for w in random_words(2, 400, ALNUM, 24)]
    a = secrets.Automaton(mixed)
    body = random_words(3, 1, ALNUM, 24)[0]
    assert reachable(a) > 40 and a.bits("sk_live_" + body) > a.bits("pk_test_" + body) + 8
    # A format of any length becomes a loop.
    rng = random.Random(4)
    loop = secrets.Automaton(["".join(rng.choices("ab1", k=1 + min(150, int(rng.expovariate(0.1))))) for _ in range(2000)])
    assert reachable(loop) <= 5 and abs(loop.bits("ab1" * 20) - loop.bits("1ba" * 20)) < 3


def test_likelihoods_against_brute_force():
    """A state's chances add up to 1, and a word's bits are those of a walk over the counts."""
    for words in (random_words(1, 300, HEX, 10, 14), random_words(2, 40, secrets.ALPHABET, 6, 30), ["only-one.value"], ["a" * 6] * 9):
        a = secrets.Automaton(words)
        for s in range(len(a.next)):
            assert abs(sum(a.chance(s, c) for c in secrets.ALPHABET) + a.chance(s, None) - 1) < 1e-9
            assert a.total[s] == a.end[s] + sum(a.count[s].values()) and a.next[s].keys() == a.count[s].keys()
        for w in words[:20] + ["zz-top.9"]:
            s, total = 0, 0.0
            for c in [*w, None]:
                seen = a.end[s] if c is None else a.count[s].get(c, 0)
                group = [] if c is None else next(g for g in secrets._CLASSES if c in g)
                near = a.end[s] if c is None else sum(a.count[s].get(x, 0) for x in group)
                share = (near + 0.05) / (a.total[s] + 0.05 * 12) / max(1, len(group))
                kinds = len(a.count[s]) + (1 if a.end[s] else 0)
                total += math.log2((seen + kinds * share) / (a.total[s] + kinds))
                if c is not None:
                    s = a.next[s].get(c, s if not a.count[s] else a.next[s][max(a.count[s], key=lambda x: (a.count[s][x], x))])  # noqa: B023
            assert abs(total - a.bits(w)) < 1e-9


def test_trigrams_against_brute_force():
    text = "short a.b-c and longer words, x=password12 naïvecafé 0123456789\nabcdef ghijkl--"
    counts, runs = secrets.run_counts(text)
    want = Counter()
    found = re.findall(r"[A-Za-z0-9+/_.=-]{6,}", text)
    code = {c: i + 1 for i, c in enumerate(secrets.ALPHABET)}
    for w in found:
        own = [0, 0, *(code[c] for c in w), 0]
        want.update(zip(own, own[1:], own[2:], strict=False))
    n = len(secrets.ALPHABET) + 1
    assert runs == len(found) and {(i // n // n, i // n % n, i % n): int(counts[i]) for i in range(n**3) if counts[i]} == dict(want)
    plain = secrets.Plain(100.0 * counts, runs)
    assert plain.bits("longer") > plain.bits("0x9-Zq") + 8


def slow_added(model, text):
    """Spans of the method, one run after the other."""
    base = brute(text)
    out = []

    def best(w):
        return max((ratio - limit, k) for k, (ratio, limit) in enumerate(zip(model.score(w), model.limits, strict=True)) if limit < math.inf)

    for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", text):
        whole = m[0].strip(".")
        if len(m[0]) < 6 or len(whole) < 6:
            continue
        parts = [(m.start() + p.start(), p[0]) for p in re.finditer("[A-Za-z0-9+_-]+", m[0]) if len(p[0]) >= 6]
        if not any(best(w)[0] >= 0 for _, w in parts):
            parts = [(m.start() + len(m[0]) - len(m[0].lstrip(".")), whole)]
        for at, w in parts:
            over, k = best(w)
            if over >= 0 and not any(b[0] < at + len(w) and at < b[1] for b in base):
                out.append((at, at + len(w), k))
    return out


def planted(spark, sf="/root/testdata/sf0.1"):
    """Documents of the test data, with credentials in two formats: some labelled, a few not."""
    keys = ["sk_live_" + w for w in random_words(8, 70, ALNUM, 24)]
    hexes = random_words(9, 70, HEX, 18)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    at = 10_000_000
    for k in range(60):
        rows.append((at + k, f"the api_key = {keys[k]} and password={hexes[k]} are set"))
    for k in range(60, 70):
        rows.append((at + k, f"see {keys[k]}. or https://host.example/a/{hexes[k]}/b, not anticonstitutionally or 1234567890123456"))
    return rows, at, keys, hexes


def test_unlabelled_credentials_of_learned_formats_are_added(spark):
    rows, at, keys, hexes = planted(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = secrets.fit(spark, docs)
    assert reachable(model.kinds[0]) > 40
    spans = {r.doc_id: r.spans for r in secrets.scan(spark, docs, model).collect()}
    for k in range(60, 70):
        text = dict(rows)[at + k]
        got = [text[int(a) : int(e)] for _, a, e in (x.split(":") for x in spans[at + k].split(",") if x)]
        assert got == [keys[k], hexes[k]]
    extra = [i for i, t in rows if i < at and spans[i] != secrets.written(brute(t or ""))]
    assert not extra  # ordinary words, numbers, addresses
    for i, t in rows[::50] + rows[-70:]:
        assert spans[i] == secrets.written(sorted(brute(t or "") + slow_added(model, t or "")))


def test_small_tables_and_edges(spark):
    rows = [(i, f"password={w} and then some ordinaryprose12 here", None) for i, w in enumerate(random_words(6, 40, HEX, 18))]
    rows += [(1000, f"bare {random_words(7, 1, HEX, 18)[0]} value", None), (1001, "longordinaryprose12 words", None)]
    rows += [(2000 + r.doc_id, r.text, None) for r in edge.sf_docs(spark).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = {r.doc_id: r.spans for r in secrets.scan(spark, docs, secrets.fit(spark, docs)).collect()}
    assert out[1000] == "assign:5:23" and not out[1001]
    assert all(out[i] == secrets.written(brute(t)) for i, t, _ in rows if i != 1000)
    docs = edge.docs(spark)
    assert secrets.scan(spark, docs, secrets.fit(spark, docs)).count() == len(edge.TEXTS)
    none = edge.empty_docs(spark)
    assert secrets.scan(spark, none, secrets.fit(spark, none)).count() == 0
