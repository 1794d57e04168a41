"""Plain Python forms of the corpus operators, to hold the queries against."""

import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash

from apilattice.llm import bpe, toxicity
from apilattice.llm.mixing import SEED

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def xx(*values):
    """Spark's xxhash64 of strings, 64-bit and (named "i") 32-bit integers; nulls change nothing."""
    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else v[1].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
            h = xxhash.xxh64_intdigest(raw, h)
    return signed(h)


def targets(sizes, weights=(1, 2, 3), cap=3):
    """Shares again and again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(sizes), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level > cap * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in open_}
        for s in full:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        open_ -= full
    return out


def taken(rows):
    """rows (id, text, source) -> (id, text, words taken), by exponential keys one after another."""
    by = defaultdict(list)
    for i, text, source in rows:
        size, th = len(WORD.findall(text or "")), xx(text)
        mean = len(text or "") / max(size, 1)
        quality = 2.0 if size >= 20 and 3 <= mean <= 13 else 1.0
        u = (((xx(("i", SEED), i, th) % (1 << 64)) >> 11) + 0.5) / (1 << 53)
        by[source].append((-math.log(u) / quality, th, (i is not None, i or 0), size, i, text))
    sizes = {s: sum(r[3] for r in found) for s, found in by.items()}
    out, want = [], targets(sizes)
    for s, found in by.items():
        epochs = int(want[s] // sizes[s]) if sizes[s] else 0
        rest = math.floor(want[s] - epochs * sizes[s])
        for _, _, _, size, i, text in sorted(found, key=lambda r: r[:3]):
            part = max(0, min(size, rest))
            rest -= size
            out.append((i, text, epochs * size + part))
    return out


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(texts):
    """The number of the class of each text; texts without words are alone."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    return [find(k) for k in range(len(sets))]


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def model(docs, labels):
    """The toxicity model of docs (id, text) and labels {id: toxic}."""
    known = sorted((xx(i), i, xx(t), t, labels[i]) for i, t in docs if labels.get(i) is not None and not held_out(i))[: toxicity.SAMPLE]
    return toxicity.fit(pa.array([k[3] for k in known], pa.string()), np.array([k[4] for k in known]) == 1)


def pipeline(docs, labels):
    """(id, token ids as bytes) of what the four stages make of docs (id, text, source)."""
    scores = model([d[:2] for d in docs], labels).scores(pa.array([d[1] for d in docs], pa.string()))
    docs = [d for d, s in zip(docs, scores) if s < toxicity.THRESHOLD]
    best = {}
    of = classes([d[1] for d in docs])
    for c, d in zip(of, docs):
        best[c] = min(best.get(c, d), d, key=lambda d: (d[0] is not None, d[0] or 0, xx(d[1])))
    docs = [d for c, d in zip(of, docs) if best[c] == d]
    coder = tiktoken.Encoding("t", pat_str=bpe.public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(), special_tokens={})
    out = []
    for i, text, n in taken(docs):
        size = len(WORD.findall(text or ""))
        out += [(i, np.array(coder.encode_ordinary(text or ""), "<u4").tobytes())] * (-(-n // max(size, 1)))
    return out
