"""Plain definitions of what the operators compute, for small inputs."""

from __future__ import annotations

import math
import re
from datetime import date, timedelta
from hashlib import md5, sha256

import numpy as np
import regex
import xxhash

GAP = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in GAP.split(text or "") if w]


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def fingerprint(text):
    w = words(lower_ascii(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, links):
    """Smallest member of each one's component; ``ids`` may repeat."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def simhash_components(docs, radius=3):
    """(id, fingerprint, smallest id) of the rows (id, text), compared pair by pair."""
    fps = [(i, fingerprint(t)) for i, t in docs]
    links = [(a, b) for n, (a, x) in enumerate(fps) for b, y in fps[:n] if (x ^ y).bit_count() <= radius]
    own = components([i for i, _ in fps], links)
    return [(i, f"{x:016x}", own[i]) for i, x in fps]


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def contaminated(docs, items, window=13, min_similarity=0.8, min_tokens=1):
    """{(doc, item): (similarity, first token)}: every item laid along every document at every offset."""
    names = {}
    coded = [[(i, np.array([names.setdefault(t, len(names)) for t in tokens(text)], dtype=np.int64)) for i, text in rows] for rows in (docs, items)]
    out = {}
    for doc, d in coded[0]:
        for item, t in coded[1]:
            w = min(window, len(t))
            if len(t) < max(1, min_tokens) or len(d) < w:
                continue
            # A pad on both sides equals nothing; offset o lays the item's first token on the document's token o.
            pad = np.full(len(t), -1)
            laid = np.lib.stride_tricks.sliding_window_view(np.r_[pad, d, pad], len(t)) == t
            run = np.cumsum(np.c_[np.zeros(len(laid), np.int64), laid], axis=1)
            equal = run[:, w:] - run[:, :-w]
            at = np.arange(len(laid))[:, None] - len(t) + np.arange(equal.shape[1])
            equal = np.where((at >= 0) & (at + w <= len(d)), equal, -1).max(axis=1)
            good = np.flatnonzero(equal / w >= min_similarity)
            if len(good):
                was = out.get((doc, item), (0.0, 1 << 60))
                out[doc, item] = max(was[0], equal[good].max() / w), min(was[1], max(int(good[0]) - len(t), 0))
    return out


def mixed(rows, weights=(5.0, 2.0, 1.0), epochs=3):
    """{id: taken} of the rows (id, source, size, quality)."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(r[2] for r in rows if r[1] == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    target, left, open_ = {}, float(sum(size.values())), set(sources)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > epochs * size[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = float(epochs * size[s])
            left -= target[s]
        open_ -= full
    out = {}
    for s in sources:
        n = min(math.floor(target[s] / size[s]), epochs) if size[s] else 0
        rest, before = target[s] - n * size[s], 0

        def key(r):
            u = (int(md5(f"0:{r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0 ** 52
            return -math.log(u) / r[3], r[0], r[2]

        for r in sorted((r for r in rows if r[1] == s), key=key):
            before += r[2]
            out[r[0]] = r[2] * (n + (before - r[2] / 2 <= rest))
    return out


# Pseudonyms: Feistel networks and number formats in plain Python; only the candidate formats are those of the operator.

def feistel(values, radices, key, tweak, rounds=10):
    n, u = len(values), len(values) // 2
    halves = [list(values[:u]), list(values[u:])]
    sizes = [radices[:u], radices[u:]]
    for turn in range(1, rounds + 1):
        to = turn % 2
        seen = ",".join(map(str, halves[1 - to]))
        head = sha256(f"{key}|{tweak}|{n}|{turn}|{seen}".encode()).hexdigest()
        for i, r in enumerate(sizes[to]):
            block = sha256(f"{head}{i // 8}".encode()).hexdigest()
            halves[to][i] = (halves[to][i] + int(block[8 * (i % 8):8 * (i % 8) + 8], 16)) % r
    return halves[0] + halves[1]


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return sum(d[0::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]])


def card_valid(digits):
    return 13 <= len(digits) <= 19 and digits[0] in "23456" and luhn(digits) % 10 == 0


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s)) % 97


def fill(shape, new, keep="A-Z0-9"):
    it = iter(new)
    return re.sub(f"[{keep}]", lambda _: next(it), shape)


def real_date(y, m, d):
    try:
        return date(int(y), int(m), int(d)) if int(y) else None
    except ValueError:
        return None


def pseudonym(m, key, pii):
    """Of one candidate; None if it isn't valid."""
    def fits(pattern):
        return regex.fullmatch(pattern, m, regex.ASCII)

    digits, bare = re.sub(r"[^0-9]", "", m), m.replace(" ", "")
    if "@" in m:
        local, rest = m.split("@", 1)
        radix = [26 if c.isalpha() else 10 if c.isdigit() else 1 for c in local]
        value = [ord(c.lower()) - 97 if c.isalpha() else int(c) if c.isdigit() else 0 for c in local]
        new = feistel(value, radix, key, "email")
        return "".join((chr(v + 65) if c.isupper() else chr(v + 97)) if c.isalpha() else str(v) if c.isdigit() else c for c, v in zip(local, new, strict=True)) + "@" + rest
    if fits(pii.DATE):
        if m[4] == "-":
            day, style = real_date(*m.split("-")), "%Y-%m-%d"
        else:
            a, b, y = re.split(r"\D", m)
            day, style = real_date(y, b, a), "%d/%m/%Y"
            if day is None:
                day, style = real_date(y, a, b), "%m/%d/%Y"
            if "." in m:
                style = "%d.%m.%Y"
        n = (day - date(1800, 1, 1)).days if day else -1
        if not 0 <= n < 146_097:
            return None
        a, b = feistel([n // 773, n % 773], [189, 773], key, "date")
        return (date(1800, 1, 1) + timedelta(days=a * 773 + b)).strftime(style)
    if fits(pii.IP):
        return ".".join(map(str, feistel([int(x) for x in m.split(".")], [256] * 4, key, "ip")))
    if fits(pii.IBAN):
        account = bare[4:]
        if mod97(account + bare[:4]) != 1:
            return None
        number = re.sub("[^0-9]", "", account)
        new = feistel([int(c) for c in number], [10] * len(number), key, f"iban:{bare[:2]}{re.sub('[^A-Z]', '', account)}")
        account = fill(account, map(str, new), "0-9")
        return fill(m, f"{bare[:2]}{98 - mod97(account + bare[:2] + '00'):02d}{account}")
    if fits(pii.PHONE):
        plus = m.startswith("+")
        shown = m.replace("(0)", "(#)")
        number = re.sub("[^0-9]", "", shown)
        code = next(regex.match(c, number).group() for c in pii.CODES if regex.match(c, number)) if plus else "1"
        number = number[len(code):] if plus else number
        low = [(2 if c >= "2" else 0) if code == "1" and i in (0, 3) else (0 if c == "0" else 1) if i == 0 else 0 for i, c in enumerate(number)]
        size = [(8 if c >= "2" else 2) if code == "1" and i in (0, 3) else (1 if c == "0" else 9) if i == 0 else 10 for i, c in enumerate(number)]
        new = feistel([int(c) - a for c, a in zip(number, low, strict=True)], size, key, f"phone:{code}")
        return fill(shown, (code if plus else "") + "".join(str(v + a) for v, a in zip(new, low, strict=True))).replace("#", "0")
    if fits(pii.SSN):
        a, g, s = map(int, m.split("-"))
        areas = [x for x in range(1, 900) if x != 666]
        a, g, s = feistel([areas.index(a), g - 1, s - 1], [898, 99, 9999], key, "ssn")
        return f"{areas[a]:03d}-{g + 1:02d}-{s + 1:04d}"
    if fits(pii.SECRET):
        new = "".join(f"{v:x}" for v in feistel([int(c, 16) for c in m], [16] * len(m), key, "secret"))
        return new.upper() if m == m.upper() else new
    if fits(pii.CARD) and card_valid(digits):
        body = digits[:-1]
        new = feistel([int(body[0]) - 2, *map(int, body[1:])], [5] + [10] * (len(body) - 1), key, "card")
        new = str(new[0] + 2) + "".join(map(str, new[1:]))
        return fill(m, new + str(-luhn(new + "0") % 10))
    return None


def pseudonymized(text, key, pii):
    """(text, number of pseudonyms) of one text."""
    if text is None:
        return None, 0
    made = 0

    def one(piece):
        nonlocal made
        new = pseudonym(piece, key, pii)
        made += new is not None
        return piece if new is None else new

    def digits_run(run):
        parts = re.findall(r"[ -]?\d+", run)
        sizes = [len(p.strip(" -")) for p in parts]
        out, i, gap = [], 0, ""
        while i < len(parts):
            for n in (1, *map(len, pii.CARD_GROUPS)):
                got = tuple(sizes[i:i + n])
                if (n == 1 and 13 <= got[0] <= 19 or got in pii.CARD_GROUPS) and card_valid(re.sub(r"\D", "", "".join(parts[i:i + n]))):
                    card = "".join(parts[i:i + n])
                    lead = card[0] if card[0] in " -" else ""
                    out += [gap, lead, card[len(lead):]]
                    i, gap = i + n, ""
                    break
            else:
                gap += parts[i]
                i += 1
        if not out:
            fit = 0
            while fit < len(parts) and sum(sizes[:fit + 1]) <= 19:
                fit += 1
            out = ["".join(parts[:fit])]
            gap = "".join(parts[fit:])
        return "".join(one(p) if p else "" for p in [*out, gap])

    def replaced(m):
        return digits_run(m.group()) if regex.fullmatch(pii.CARD, m.group(), regex.ASCII) else one(m.group())

    return regex.sub(pii.PATTERN, replaced, text, flags=regex.ASCII), made


def without_passages(docs, window=13):
    """(id, n_words, n_removed, SHA-256 of the kept words) of the rows (id, text), window by window."""
    low = {}
    split = [(d, words(t)) for d, t in docs]
    for d, w in split:
        for i in range(len(w) - window + 1 if d is not None else 0):
            k = tuple(w[i:i + window])
            low[k] = min(low.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1 if d is not None else 0):
            if low[tuple(w[i:i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


def languages(rows, trains, blocks=400, chars=1024, level=5, piece=1024, margin=0.005):
    """Language, score and whether rejected of every (doc_id, text, lang), learnt from the rows where ``trains`` holds; only the library's definition is shared, no code."""
    import hashlib
    import re
    import unicodedata

    import xxhash
    import zstandard

    def letters(text):
        return any(unicodedata.category(c)[0] == "L" for c in text)

    def plain(text):
        return b" ".join(re.sub(rb"[^a-z\x80-\xff]", b" ", text.lower().encode()).split())

    drawn = {}
    for doc_id, text, lang in rows:
        if lang is None or text is None or not trains(doc_id):
            continue
        name = xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), 42)
        name -= (1 << 64) * (name >= 1 << 63)
        for b in range(0, len(text), chars):
            if letters(text[b:b + chars]):
                drawn.setdefault(lang, []).append((hashlib.md5(f"{name}:{b // chars}".encode()).hexdigest(), text[b:b + chars]))
    tools = {}
    for lang, parts in drawn.items():
        content = b" ".join(plain(t) for _, t in sorted(parts)[:blocks][::-1])
        tools[lang] = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
    out = {}
    for doc_id, text, _ in rows:
        if text is None or not letters(text):
            out[doc_id] = ("und", 0.0, True)
            continue
        raw = plain(text)
        sizes = sorted((sum(len(tool.compress(raw[i:i + piece])) for i in range(0, len(raw), piece)), lang) for lang, tool in tools.items())
        score = (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0
        out[doc_id] = (sizes[0][1], score, score < margin)
    return out
