"""Queries against plain Python over the whole tables of the smallest size."""

import hashlib
import io
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash

from palimpsest.llm import edits, lines, packing, pieces, pii, queries, simhash, substrings, warc
from tests.conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def result(spark, name):
    return {r.doc_id: r for r in queries.queries()[name](spark, DATA).collect()}


def test_simhash(spark, docs):
    def fingerprint(text):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if words else 0

    want = {i: fingerprint(t) for i, t in docs.items()}
    got = result(spark, "op1_simhash")
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == want
    least = {i: i for i in docs}
    changed = True
    while changed:
        changed = False
        for a, b in combinations(docs, 2):
            if (want[a] ^ want[b]).bit_count() <= 4 and least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    assert {i: r.component_id for i, r in got.items()} == least


def test_golay_keys_meet_within_four_bits():
    golay, rng = simhash.Golay(), np.random.default_rng(5)
    fps = rng.integers(-(1 << 63), (1 << 63) - 1, 400)
    near = fps.view(np.uint64).copy()
    for k in range(len(near)):
        for b in rng.choice(64, 4, replace=False):
            near[k] ^= np.uint64(1) << np.uint64(b)
    (ka, oa), (kb, ob) = simhash.keys_of(fps, golay), simhash.keys_of(near.view(np.int64), golay)
    assert all(set(ka[oa == k]) & set(kb[ob == k]) for k in range(len(fps)))


def test_large_groups_of_near_copies(spark):
    rng = np.random.default_rng(1)
    fps = {int(x) for x in rng.integers(-(1 << 62), 1 << 62, 300)}
    for centre in list(fps)[:3]:
        for _ in range(400):
            flips = rng.choice(62, rng.integers(1, 4), replace=False)
            fps.add(centre ^ sum(1 << int(b) for b in flips))
    fps = sorted(fps)
    from palimpsest.llm.graph import components

    root = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"))).collect()}
    array = np.array(fps).view(np.uint64)
    label = {x: x for x in fps}
    todo = set(fps)
    while todo:
        group, queue = set(), [min(todo)]
        while queue:
            x = queue.pop()
            if x in group:
                continue
            group.add(x)
            close = np.bitwise_count(array ^ np.uint64(x % (1 << 64))) <= 4
            queue.extend(int(y) for y in array[close].view(np.int64))
        for x in group:
            label[x] = min(group)
        todo -= group
    assert {x: root.get(x, x) for x in fps} == label


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: library.encode(t, add_special_tokens=False).ids + [0] for i, t in docs.items()}
    rows = queries.op2_packing(spark, DATA).collect()
    pieces_of, filled = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        pieces_of.setdefault(r.doc_id, []).append((r.start, r.length))
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans, whole in [(s, len(ids[i])) for i, s in pieces_of.items()] + [(s, None) for s in filled.values()]:
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == whole if whole is not None else at <= 1024
    assert sum(map(len, ids.values())) > 0.97 * 1024 * len(filled)


@pytest.mark.parametrize("text", ["", " ", "a  b", "a   b", "a\n b \n\n c", "it's 3.14 <|endoftext|> x", "naïve \t tab nbsp", "  lead", "trail  ", "x" * 500, "中文 字", "a\r\nb"])
def test_segments_encode_as_whole_texts(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = np.frombuffer(packing.byte_encoder(packing.tokenizer_path())(text), "<u4").tolist()
    assert own == library.encode(text, add_special_tokens=False).ids


def test_plan_holds_every_piece_and_is_near_the_bound():
    rng = np.random.default_rng(2)
    histogram = Counter(rng.integers(1, 129, 5000).tolist())
    plan = packing.plan(dict(histogram), 128)
    held = Counter()
    for n, pattern in plan.patterns:
        assert sum(a * b for a, b in pattern.items()) <= 128
        for length, copies in pattern.items():
            held[length] += n * copies
    assert held == histogram
    assert plan.sequences <= 1.02 * sum(a * b for a, b in histogram.items()) / 128 + 2


def test_substrings(spark, docs):
    words = {i: WORD.findall(t) for i, t in docs.items()}
    seen = Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    got = result(spark, "op5_substring_dedup")
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("often", [2, 5, 32])
def test_substrings_within_one_text_and_across_flushes(spark, monkeypatch, often):
    monkeypatch.setattr(substrings, "HELD", 50)
    monkeypatch.setattr(substrings, "BYTES", 600)
    monkeypatch.setattr(substrings, "OFTEN", often)
    rng = np.random.default_rng(3)
    passage = [f"p{k}" for k in range(60)]
    texts = ["a " * 100, " ".join(passage), " ".join(["x", *passage[:40], "y"])] + [" ".join([*map(str, rng.integers(0, 10**6, 30)), *passage[5:50], *map(str, rng.integers(0, 10**6, 20))]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.kept for r in substrings.dedup(df).collect()}
    words = [t.split() for t in texts]
    seen = Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
    for i, w in enumerate(words):
        gone = {k + j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(35)}
        assert got[i] == " ".join(x for k, x in enumerate(w) if k not in gone)


def test_sentencepiece(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    for i, r in result(spark, "op6_sentencepiece").items():
        ids = library.encode(docs[i])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_sentencepiece_on_random_texts():
    import random

    import sentencepiece

    rng, codec = random.Random(4), pieces.Codec()
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    alphabets = ["ab  \n\tzé▁中🙂the ing 12.,\x00<s>", "etaoinsh", "abcdefghijklmnopqrstuvwxyz ", "  a", "aaab"]
    texts = ["", " ", "▁", "a" * 300, " " * 40] + ["".join(rng.choice(a) for _ in range(rng.randint(0, 60))) for a in alphabets for _ in range(300)]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids == library.encode(text)
        assert codec.decode(ids) == library.decode(ids)
    for ids in ([198, 172], [198], [258, 261, 231, 187], [0, 261, 1, 2, 300], [1, 261], [259, 259], [243, 162, 156, 261]):
        assert codec.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "etaoinshr", "ab", "ABCabc019+/=", "的一是在不了有和人这"])
def test_sentencepiece_on_long_texts_without_spaces(letters):
    import random

    import sentencepiece

    text = "".join(random.Random(2).choices(letters, k=150_000))
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    codec = pieces.Codec()
    ids = codec.encode([text])[0]
    assert ids == library.encode(text) and codec.decode(ids) == library.decode(ids)


def test_queued_merges_keep_the_order(monkeypatch):
    import random

    import sentencepiece

    monkeypatch.setattr(pieces, "QUEUED", 4)
    rng, codec = random.Random(5), pieces.Codec()
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    for alphabet in ("ab  \n\tzé▁中🙂the ing 12.,\x00<s>", "etaoinsh", "aaab"):
        for _ in range(200):
            text = "".join(rng.choices(alphabet, k=rng.randint(0, 300)))
            assert codec.encode([text])[0] == library.encode(text)


def _mix(x):
    mask = (1 << 64) - 1
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor & mask
    return x ^ x >> 31


def slow_fingerprint(text):
    """One step after another: the character is written, and a bit of the step and the character's class says whether to go on.

    What is written is read at the places of the 512 bits, each by jump hashing of twice the number of characters.
    """
    written, waited, at = [], 0, 0
    codes = [ord(c) for c in text]
    wanted = []
    for k in range(edits.BITS):
        key, place, ahead = _mix(k + 1), 0, 0
        while ahead < 2 * len(codes):
            place = ahead
            key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
            ahead = int((place + 1) * (2.0**31 / ((key >> 33) + 1)))
        wanted.append(place)
    while at < len(codes) and len(written) <= max(wanted):
        written.append(codes[at] + 1)
        waited += 1
        kind = (codes[at] * 2654435761 & 0xFFFFFFFF) >> 28
        step = (len(written) - 1) % edits.PERIOD
        if _mix(step * edits.CLASSES + kind + (edits.SEED << 32)) & 1 or waited == edits.WAIT:
            at, waited = at + 1, 0
    read = [written[p] if p < len(written) else 0 for p in wanted]
    return [bool(_mix(c * edits.BITS + k) & 1) for k, c in enumerate(read)]


def test_fingerprints(spark, docs):
    """The whole query: prints, likeness and classes, against a walk step by step and all pairs of documents."""
    order = sorted(docs)
    got = result(spark, "op8_fingerprints")
    prints = {}
    as_hex = lambda bits: f"{int(''.join('01'[b] for b in bits), 2):0128x}"
    alike = lambda a, b: max(0.0, 2 * sum(x == y for x, y in zip(a, b, strict=True)) / 512 - 1)
    for i, after in zip(order, [*order[1:], order[0]], strict=True):
        quarter = len(docs[i]) // 4
        changed = docs[i][: len(docs[i]) - quarter] + docs[after][:quarter]
        a, b, c = (prints[t] if t in prints else prints.setdefault(t, slow_fingerprint(t)) for t in (docs[i], changed, docs[after]))
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(docs[i]), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (as_hex(a), as_hex(b))
        assert (r.near_edited, r.near_next) == (alike(a, b), alike(a, c))
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.97
    least = {i: i for i in order}
    links = [(i, j) for i, j in combinations(order, 2) if alike(prints[docs[i]], prints[docs[j]]) >= 0.8]
    for _ in order:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    joined = [got[i].class_id == got[j].class_id for i, j in links]
    assert len(links) > 5 and np.mean(joined) >= 0.95
    assert all(least[i] == least[got[i].class_id] for i in order)  # no class joins what no chain of links joins


def test_likeness_by_number_of_edits():
    """The class in edits a text, as the README gives it: one edit keeps texts of any length together, many do not."""
    import random

    rng = random.Random(11)
    letters = "etaoin shrdlu cmfwyp"
    for length in (300, 2000, 10_000):
        texts = ["".join(rng.choices(letters, k=length)) for _ in range(30)]
        shares = {}
        for edits_made in (1, 3, 30):
            near = []
            for t in texts:
                x = list(t)
                for _ in range(edits_made):
                    at = rng.randrange(len(x))
                    gone, come = rng.choice([(1, 1), (1, 0), (0, 1)])
                    x[at : at + gone] = rng.choices(letters, k=come)
                near.append(edits.likeness(edits.fingerprint(t), edits.fingerprint("".join(x))))
            shares[edits_made] = np.mean([n >= 0.8 for n in near])
        print(length, shares)
        assert shares[1] >= 0.85 and shares[3] >= 0.6
        unrelated = [edits.likeness(edits.fingerprint(a), edits.fingerprint(b)) for a, b in zip(texts, texts[1:], strict=False)]
        assert max(unrelated) < 0.4


def test_edit_classes_join_copies_and_near_copies(spark):
    rng = np.random.default_rng(6)
    base = ["".join(rng.choice(list("abcdefgh ijklmno"), 800)) for _ in range(12)]
    texts = base + [t[:400] + "#" + t[401:] for t in base[:6]] + base[:3]
    prints = spark.createDataFrame([(k, edits.to_hex(edits.fingerprint(t))) for k, t in enumerate(texts)], "doc_id long, fingerprint string")
    found = {r.doc_id: r.class_id for r in edits.classes(prints).collect()}
    bits = [edits.fingerprint(t) for t in texts]
    for a, b in combinations(range(len(texts)), 2):
        if edits.likeness(bits[a], bits[b]) >= 0.9:
            assert found[a] == found[b]
        if edits.likeness(bits[a], bits[b]) < 0.5:
            assert found[a] != found[b]


def slow_lines(texts):
    """Kept texts by doc id: a line goes if any earlier line has four fifths of the union in common."""
    earlier, out = [], {}
    for i in sorted(texts):
        kept = []
        for line in texts[i].split("\n"):
            words = set(WORD.findall(line))
            if not words:
                kept.append(line)
                continue
            if not any(9 * len(words & e) >= 4 * (len(words) + len(e)) for e in earlier):
                kept.append(line)
            earlier.append(words)
        out[i] = "\n".join(kept)
    return out


def test_lines(spark, docs):
    got = result(spark, "op9_line_dedup")
    want = slow_lines(docs)
    assert {i: r.kept_sha256 for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}


def test_lines_with_many_candidates(spark, monkeypatch):
    monkeypatch.setattr(lines, "WITNESSES", 2)
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(20)]
    texts = {}
    for i in range(80):
        words = list(base)
        for k in rng.choice(20, rng.integers(0, 6), replace=False):
            words[k] = f"v{rng.integers(0, 12)}"
        texts[i] = " ".join(words) + "\nshort line"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.dedup(df).collect()} == slow_lines(texts)


def test_base_spans():
    import random

    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def luhn(digits):
        doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
        return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0

    def plain(text):
        found = [("email", *m.span()) for m in email.finditer(text)]
        found += [("ip", *m.span()) for m in ip.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
        found += [("card", *m.span()) for m in card.finditer(text) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
        found += [("phone", *m.span()) for m in phone.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))

    rng = random.Random(9)
    for alphabet in ("a@.1-_ %+", "0123456789 -.+()", "0. 12@a.b", "+1 (2)-3.4"):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert pii.base_spans(text) == plain(text)


def test_warc_pages_without_ids_and_with_one_id(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", b"one"), (1, "http://b/", b"two"), (None, "http://c/", b"three"), (None, None, b"four"), (2, "http://d/", b"one")], "page_id long, url string, payload binary")
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages, str(tmp_path / "w")).collect())
    assert got == [("1", 3, "response", None), ("1", 3, "response", None), ("2", 3, "revisit", 1), ("None", 4, "response", None), ("None", 5, "response", None)]


def test_warc_large_payloads_fill_files_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 1 << 20)
    rng = np.random.default_rng(4)
    pages = spark.createDataFrame([(k, "http://a/", rng.bytes(300_000)) for k in range(12)], "page_id long, url string, payload binary").coalesce(1)
    got = warc.round_trip(pages, str(tmp_path / "w")).collect()
    assert len(got) == 12 and {r.payload_bytes for r in got} == {300_000}
    assert max(f.stat().st_size for f in (tmp_path / "w").glob("*.gz")) < 2 << 20


def test_warc_large_payloads_side_by_side(spark, tmp_path, monkeypatch):
    """Many small pages and then large ones: a count of mean records would put all large ones into one file."""
    monkeypatch.setattr(warc, "ARCHIVE", 1 << 20)
    rng = np.random.default_rng(5)
    sizes = [200] * 3000 + [200_000] * 40 + [3_000_000]
    rows = [(k, "http://a/", rng.bytes(n)) for k, n in enumerate(sizes)]
    pages = spark.createDataFrame(rows, "page_id long, url string, payload binary").coalesce(1)
    path = str(tmp_path / "w")
    got = {r.page_id: r.payload_bytes for r in warc.round_trip(pages, path).collect()}
    assert got == dict(enumerate(sizes))
    stored = sorted(f.stat().st_size for f in (tmp_path / "w").glob("*.gz"))
    assert stored[-1] < 3_100_000 and stored[-2] < 2 << 20 and len(stored) < 60


def test_masks():
    assert pii.mask("mail a@b.c or 1.2.3.4", "email:5:10,ip:14:21") == "mail [EMAIL] or [IP]"
    assert pii.mask("x 4111111111111111 y", "card:2:18,phone:2:10") == "x [CARD] y"


def test_warc_records_are_cut_by_length(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", b"x\r\n\r\ny"), (2, "http://b/", b"x\r\n\r\ny"), (3, None, None), (4, "http://c/", bytes(range(256)))], "page_id long, url string, payload binary")
    path = str(tmp_path / "w")
    got = {r.page_id: r for r in warc.round_trip(pages, path).collect()}
    assert [(got[k].record_type, got[k].refers_to, got[k].payload_bytes) for k in (1, 2, 3, 4)] == [("response", None, 6), ("revisit", 1, 6), ("response", None, 0), ("response", None, 256)]
    whole = [warc.parse(io.BytesIO(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\nab"))]
    with pytest.raises(ValueError, match="ends within"):
        list(whole[0])
    nested = warc.captures(warc.read_archives(spark, path)).collect()
    assert len(nested) == 4 and all(r.request.http.startswith("GET ") and r.metadata.id for r in nested)
    assert {bytes(r.response.payload) for r in nested if r.response.payload is not None} == {b"x\r\n\r\ny", b"", bytes(range(256))}
