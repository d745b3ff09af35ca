"""Brute-force versions shared by tests."""

import re

import xxhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def find_classes(prints, radius=2):
    """Fingerprint to the least id reachable over links of radius bits."""
    fps = sorted({f for _, f in prints})
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= radius:
                parent[find(a)] = find(b)
    least = {}
    for i, f in prints:
        root = find(f)
        if i is not None:
            least[root] = min(i, least.get(root, i))
    return {f: least.get(find(f)) for f in fps}
