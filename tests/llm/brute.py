"""Plain restatements that the tests hold the operators against."""

import hashlib

import xxhash


def simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps, bits=3):
    """fps: {id: fingerprint} -> {id: least id that can be reached}."""
    left, out = sorted(fps), {}
    while left:
        root, todo, seen = left[0], [left[0]], {left[0]}
        while todo:
            x = todo.pop()
            for y in left:
                if y not in seen and (fps[x] ^ fps[y]).bit_count() <= bits:
                    seen.add(y)
                    todo.append(y)
        for x in seen:
            out[x] = root
        left = [x for x in left if x not in seen]
    return out


def removed(docs, window=100):
    """docs: [(id, bytes)] in order -> [(n_removed, n_spans, sha256 of the rest)]."""
    first = {}
    for k, (_, b) in enumerate(docs):
        for i in range(len(b) - window + 1):
            first.setdefault(b[i : i + window], (k, i))
    out = []
    for k, (_, b) in enumerate(docs):
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if first[b[i : i + window]] < (k, i):
                gone[i : i + window] = b"\1" * window
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out
