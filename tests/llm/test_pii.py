"""Personal data against plain Python that shares nothing with the operator, and on odd ids."""

import hashlib
import re
from collections import Counter, defaultdict

from palimpsest.llm import pii, queries
from tests.conftest import DATA

KINDS = ["email", "ip", "card", "phone", "secret"]
SPACE = r"[\x20\x09-\x0D]"
DELIMITED = re.compile(r"[^\x20\x09-\x0D\"'()\[\]{}<>=,;&?!#*$%|]+")
SECRET = re.compile(r"AKIA[0-9A-Z]{16}|(?=.*[0-9])(?=.*[a-f])[0-9a-f]{12,}")


def luhn(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def base_of(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def contexts(text, a, b):
    words = [w for w in re.split(f"{SPACE}+", text[:a]) if w]
    after = re.match(r"[\x20\x09-\x0D\"'()\[\]{}<>=,;&?!#*$%|]*([^\x20\x09-\x0D]*)", text[b:])[1]
    bare = lambda w: re.sub(r"[0-9\"'()\[\]{}<>#*$%&!?,;.:=|]", "", w).lower()
    short = lambda w: w if len(w) <= 40 else hashlib.sha256(w.encode()).hexdigest()
    near, far = (short(bare(words[-n])) if len(words) >= n else "" for n in (1, 2))
    after = short(bare(after))
    key = re.search(r"([A-Za-z0-9_.-]+)[ \"']{0,3}[=:][ \"']{0,3}\Z", text[:a])
    name = key[1].lower().lstrip("0123456789_.-") if key else ""
    out = {f"key {short(name)}"} if len(name) > 1 else set()
    out |= {f"before {far} {near}"} if near and far else set()
    return out | ({f"around {near} {after}"} if near and after else set())


def found_in(texts):
    """{number: (base, all spans)} of the texts."""
    rows = defaultdict(list)
    for i, text in texts.items():
        base = base_of(text)
        rows[i] = [(a, b, contexts(text, a, b), text[a:b].lower(), k, True) for k, a, b in base]
        covered = {p for _, a, b in base for p in range(a, b)}
        masked = "".join(" " if p in covered else c for p, c in enumerate(text))
        for m in DELIMITED.finditer(masked):
            a = m.start() + len(m[0]) - len(m[0].lstrip(".:-/"))
            value = m[0].strip(".:-/")
            if len(value) >= 6 and re.search("[0-9]", value):
                rows[i].append((a, a + len(value), contexts(text, a, a + len(value)), value.lower(), "secret" if SECRET.fullmatch(value) else None, False))
    edges = {(p, v) for r in rows.values() for _, _, ps, v, _, _ in r for p in ps}
    seeds = {(v, k) for r in rows.values() for _, _, _, v, k, _ in r if k}
    total, known, trusted = Counter(p for p, _ in edges), seeds, {}
    for _ in range(10):
        kinds = defaultdict(set)
        for v, k in known:
            kinds[v].add(k)
        hits = Counter((p, k) for p, v in edges for k in kinds[v])
        trusted = {(p, k): n / (total[p] + 1) for (p, k), n in hits.items() if n >= 4 and n / (total[p] + 1) >= 0.8}
        doubt = defaultdict(lambda: 1.0)
        for p, v in edges:
            for k in KINDS:
                doubt[v, k] *= 1 - trusted.get((p, k), 0)
        known = seeds | {vk for vk, d in doubt.items() if d <= 0.1}
    out = {}
    for i, r in rows.items():
        spans = {(k, a, b) for a, b, _, _, k, own in r if own}
        spans |= {(k, a, b) for a, b, ps, v, _, own in r if not own for k in KINDS if (v, k) in known or any((p, k) in trusted for p in ps)}
        out[i] = base_of(texts[i]), sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return out


def line(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_query(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    want = found_in(texts)
    for r in queries.op10_pii(spark, DATA).collect():
        base, spans = want[r.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in base) for kind in KINDS[:4])
        assert r.base_sha256 == hashlib.sha256(line(base).encode()).hexdigest()
        assert r.spans == line(spans)


def planted():
    """Identifiers that no fixed pattern knows, beside ones that one does, in the same contexts; and decoys."""
    rows = [f"api_key: {k:x}a0b1c2d3e4f5{k:x}f and more" for k in range(1, 16)] + ["api_key: ZEBRA-77-PLURAL and more", "api_key: " + "Long" * 60 + "1 end"]
    rows += [f"write to user{k}@mail.example.com about it" for k in range(10)] + ["write to room-77-at-home about it", "the year 1999bc passed", "chapter 20000x here"]
    return rows + ['{"id":"zz","token":"deadbeef00112233","x":1}'] * 2


def test_contexts_find_what_no_pattern_knows(spark):
    texts = dict(enumerate(planted()))
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {i: line(spans) for i, (_, spans) in found_in(texts).items()}
    assert got[15] == "secret:9:24" and got[16] == "secret:9:250"  # by its key, of any length
    assert got[27] == "email:9:24"
    assert got[28] == got[29] == ""


def test_rows_without_an_id_or_with_one_id(spark):
    rows = [(1, "mail amy@example.com now"), (1, "at 10.0.0.1 now"), (None, "secret mail amy@example.com"), (None, None), (None, "none"), (2, "at 10.0.0.1 now"), (2, "at 10.0.0.1 now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((str(r.doc_id), r.text or "") for r in pii.redact(docs).collect())
    assert out == sorted([("1", "mail [EMAIL] now"), ("1", "at [IP] now"), ("None", "secret mail [EMAIL]"), ("None", ""), ("None", "none"), ("2", "at [IP] now"), ("2", "at [IP] now")])
    found = sorted((str(r.doc_id), r.spans) for r in pii.find(docs).collect())
    assert found == sorted([("1", "email:5:20"), ("1", "ip:3:11"), ("None", "email:12:27"), ("None", ""), ("None", ""), ("2", "ip:3:11"), ("2", "ip:3:11")])


def test_keys_of_any_length_and_no_rounds(spark):
    long = "very_long_" * 12 + "authorization_bearer_token_value"
    assert pii._key(f"{long} = ", len(long) + 3) == pii._short(long) != long and pii._key("authorization_bearer_token_value='", 34) == "authorization_bearer_token_value"
    assert [pii._key(t, len(t)) for t in ("x-api-key2: ", '"key" : "', "10:", "a=", "no key ", "=")] == ["x-api-key2", "key", "", "", "", ""]
    texts = [f"x-api-key2: {'abcdef0123456' + str(k)}" for k in range(12)] + ["x-api-key2: zzz-999-yyy"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert pii.find(df).where("doc_id = 12").first().spans == "secret:12:23"
    assert pii.find(df, 0).where("doc_id = 12").first().spans == ""
