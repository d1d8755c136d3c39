"""Brute-force versions of the operators and small tables for them."""

import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict
from itertools import combinations

from arraylume.llm import secrets

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, shard int, slot long, h long, id long, score double, spans string, key long"


def table(spark, texts, ids=None):
    """Documents with further columns whose names clash with those of results."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", None if n % 7 == 3 else f"src{n % 3}", len(t or ""), 5, 1, 2, 3, 4, 0.5, "x", 9) for n, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


def vocabulary(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def corpus(seed=3, n=60, size=(1, 120)):
    """Texts with exact and near copies, shared passages, nulls and blanks."""
    rng = random.Random(seed)
    words = vocabulary(rng, 400)
    passage = [rng.choice(words) for _ in range(70)]
    texts = [None, "", " \t\n\x0b\x0c\r ", "one", "One two", "one two three", "a b c d e f g h i j"]
    for _ in range(n):
        doc = [rng.choice(words) for _ in range(rng.randint(*size))]
        kind = rng.random()
        if kind < 0.2:
            doc[len(doc) // 2 : len(doc) // 2] = passage[rng.randint(0, 20) : rng.randint(50, 70)]
        texts.append(" ".join(doc))
        if kind > 0.7:
            for _ in range(rng.randint(1, 4)):
                near = list(doc)
                for _ in range(rng.randint(0, max(1, len(near) // 40))):
                    near[rng.randrange(len(near))] = rng.choice(words)
                texts.append(rng.choice([" ", "\n", " \t"]).join(near))
    return texts


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def decontaminated(texts, items, window=13, share=20):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    windows = set()
    for item, text in items:
        w = split(text)
        if item is not None and w:
            windows |= {(item, tuple(w[i : i + window])) for i in range(max(1, len(w) - window + 1))}
    out = []
    for text in texts:
        w = split(text)
        hit, found = set(), set()
        for item, g in windows:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found.add(item)
        out.append((len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit) and share * len(hit) >= len(w)))
    return out


def rules(text):
    text = text or ""
    w = BLANK.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if BLANK.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def shingle_set(text, width):
    w = BLANK.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def jaccard_components(ids, texts, width=3, percent=90):
    sets = [shingle_set(t, width) for t in texts]
    home = list(range(len(ids)))

    def top(i):
        while home[i] != i:
            i = home[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            home[top(i)] = top(j)
    least = {}
    for i, d in enumerate(ids):
        least[top(i)] = min(least.get(top(i), d), d)
    return [(len(s), least[top(i)]) for i, s in enumerate(sets)]


def without_repeats(ids, texts, window=50):
    words = [BLANK.findall(t or "") for t in texts]
    first = {}
    for d, w in zip(ids, words):
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, d), d)
    out = []
    for d, w in zip(ids, words):
        gone = {i + k for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for k in range(window)}
        out.append((len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def url(value, rules):
    host = path = ""
    if value and "://" in value:
        rest = value.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(FOLD)
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p if _ else ""):
            best = max(best or (-1, -1, ""), (h.count(".") + 1, len(p), rule, verdict))
    return host, path, best[2] if best else None, best[3] if best else "allow"


def crc(data):
    return zlib.crc32(data)


def secret_spans(text, table, threshold):
    """The base spans and all spans of a text, as the query joins them."""
    text = text or ""
    found = [("assign", *m.span()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    base = sorted(found, key=lambda x: (x[1], secrets.KINDS.index(x[0])))
    for m in re.finditer(secrets.TOKEN, text):
        code = [secrets.ALPHABET.index(c) for c in m[0]]
        mean = sum(table[a * secrets.WIDTH + b] for a, b in zip(code, code[1:])) / (len(code) - 1)
        if mean >= threshold and not any(s < m.end() and m.start() < e for _, s, e in base):
            found.append(("markov", *m.span()))
    every = sorted(found, key=lambda x: (x[1], secrets.KINDS.index(x[0])))
    return [",".join(f"{k}:{s}:{e}" for k, s, e in x) for x in (base, every)]


def redacted(text, table, threshold):
    text, out, at = text or "", "", 0
    for s, e in [tuple(map(int, x.split(":")[1:])) for x in secret_spans(text, table, threshold)[1].split(",") if x]:
        if s >= at:
            out += text[at:s] + "[secret]"
        at = max(at, e)
    return out + text[at:]


def check_packed(rows, ids, capacity):
    """Checks pieces against the ids of each document: every id lies in exactly one
    piece, windows have no gap and don't exceed the capacity. Returns how many there are."""
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        data = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == crc(struct.pack(f"<{len(data)}I", *data)) and len(data) == r["length"] > 0 and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for found, sizes in ((pieces, {k: len(v) for k, v in ids.items()}), (windows, None)):
        for key, parts in found.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at == sizes[key] if sizes else at <= capacity
    return len(windows)
