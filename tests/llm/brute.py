"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def op1(rows, n=13):
    owner = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            owner[k] = min(owner.get(k, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - n + 1):
            if owner[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out)


def op8(rows, n=200):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter()
    for _, b in data:
        seen.update(b[i : i + n] for i in range(len(b) - n + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out)


def op5(rows, k=5, num=75):
    sets = {}
    for d, t in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(t)]
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for d, s in sets.items():
        for e in {e for x in s for e in by[x] if e > d}:
            i = len(s & sets[e])
            if 100 * i >= num * len(s | sets[e]):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets.items())


def crc(ids):
    import struct

    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def op3(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for d, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        out.append((d, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    return sorted(out)


def op7(rows, cap=4096):
    """The pieces, without their places."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for d, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        out += [(d, i // cap, i, len(ids[i : i + cap]), crc(ids[i : i + cap])) for i in range(0, len(ids), cap)]
    return sorted(out)


def bins_are_sound(placed, cap=4096):
    """placed: rows of op7. Gapless from 0 and at most cap long."""
    by = defaultdict(list)
    for r in placed:
        by[r[5]].append((r[6], r[3]))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= cap
    return len(by)


def op11(rows):
    groups = defaultdict(list)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for d, t in rows:
        groups[(t or "").translate(low)].append(d)
    out = []
    for t, ids in groups.items():
        stays = max(ids)
        for i, d in enumerate(sorted(ids)):
            out.append((d, stays, len(ids), d == stays and i == len(ids) - 1, sha(t)))
    return sorted(out)


def op12(rows, byte_tokens, piece_tokens):
    """byte_tokens and piece_tokens: text to [(id, bytes)]."""
    docs, held = [], Counter()
    for d, t in rows:
        want = (" " + (t or "")).encode()
        a, b = (byte_tokens(" " + t), piece_tokens(t)) if t else ([], [])
        if not t or any(b"".join(x for _, x in tokens) != want for tokens in (a, b)):
            a, b = [], []
        cuts = [set(), set()]
        for tokens, cut in zip((a, b), cuts):
            at = 0
            for _, x in tokens:
                at += len(x)
                cut.add(at)
        both = sorted(cuts[0] & cuts[1])
        groups = [([], []) for _ in both]
        for side, tokens in enumerate((a, b)):
            at = g = 0
            for i, x in tokens:
                at += len(x)
                groups[g][side].append(i)
                g += both[g] == at
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        held.update(links.keys())
        docs.append((d, len(a), len(b), groups, links))
    top = Counter()
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    out = []
    for d, na, nb, groups, links in docs:
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        best = sum(n for (a, b), n in links.items() if held[a, b] == top[a])
        out.append((d, na, nb, len(groups), sum(links.values()), best, sum(n * held[k] for k, n in links.items()), sha(text) if groups else ""))
    return sorted(out)


def runs(w, least=24, times=3):
    """(start, length, least period) of every run of a sequence."""
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(least, times * q) and not any(all(w[x] == w[x + r] for x in range(i, i + size - r)) for r in range(1, q)):
                out.append((i, size, q))
            i = j + 1 if j == i else j
    return sorted(out, key=lambda r: (r[0], r[2]))


def op13(rows):
    out = []
    for d, t in rows:
        w = words(t)
        n, h = len(w), zlib.crc32(str(d).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        found = runs(w)
        gone = {i for s, size, q in found for i in range(s + q, s + size)}
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        out.append((d, len(found), *best, milli, sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=lambda r: r[0])
