"""Operator 8: personal data and secrets, by a skip-chain conditional random field.

Tokens are cut at white space, quotes, commas, semicolons, bars, ``&``, brackets and the signs ``=`` and ``:``, so a line
without blanks has as many as its values; of ``password=x`` the entity is ``x``. A whole token is looked at, however long.
Colons inside a run of hexadecimal digits and colons (an address, a time) don't cut. The field's nodes are the tokens that hold
a digit, ``@`` or ``CAPITALS`` capital letters (keys may have no digit), those that a sign joins to a key word, capitalised words
after a title or a name's key word, parts of account and card numbers in groups, and all tokens of the document equal to one
of these; entity labels are allowed on them alone, so every other token is O whatever its neighbours
are and needs no node. Successive nodes with only blanks between share a chain potential. A secret goes on over signs inside
it (``password=ab:cd``), but ends at commas, quotes, brackets, bars and ``&``. All equal or
similar tokens of a document (equal after edge punctuation, case and separators are dropped, or with the same part after
``@``) share one potential, whatever their number and distance: skip edges join each of them to one more node that stands for
the group, so edges grow in proportion to tokens. What tokens are by themselves is then said once, by the group's node;
so is what stands around them, and members add only the numbers beside them (parts of telephone numbers). Loopy message passing (sum-product, damped) over both kinds of edges gives every node's
label; a document's messages are passed until none changes by more than ``TOLERANCE``. After ``FIRM`` rounds each round
changes less than the one before, so that this ends also where messages would circle.

The weights are trained here, on the driver, by gradient steps on the likelihood with expectations from the same message
passing, over documents that ``examples`` composes: personal data in varied forms and look-alikes (dates, versions, prices,
amounts, ordinals). The model has a fixed size. One pass over the scan; nothing is shuffled.

Found are mail, IPv4 and IPv6 addresses, card and account numbers, social security numbers (ID), telephone numbers, secrets, and
names of persons that a title or key word introduces, with their later mentions.

Defined cases: a null or empty text has no entities; a very long one is read whole, by itself if longer than a slice. Of labels with
equal belief the first in ``LABELS`` is taken. Ids may be null or repeat: every row gives its own entities. A document
with equal entities reports each occurrence. Other columns are never read. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import ipaddress
import random
import re
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refgraph.llm import text as tx

LABELS = ("O", "EMAIL", "IP", "CARD", "SECRET", "PHONE", "PHONE-I", "IBAN", "ID", "PERSON")
BITS = 13
TOLERANCE = 1e-3
FIRM = 60
EXAMPLES = 1000
STEPS = 160
CAPITALS = 12
_KEY = re.compile(r"(?i)(password|passwd|pwd|secret|token|api[-_]?key|access[-_]?key|auth|key)[\w.-]*$")
_TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "sir", "madam", "herr", "frau", "monsieur", "madame", "mme", "mlle", "señor", "señora", "sr", "sra"}
_NAMED = {"name", "names", "fullname", "full_name", "full name", "firstname", "first_name", "lastname", "last_name", "surname", "customer", "contact", "patient", "employee", "nombre", "nom"}
_CALLED = {"tel", "phone", "telephone", "telefon", "fon", "fax", "mobile", "mobil", "call", "cell", "tél", "teléfono"}
_CUTS = "\"`<>[]{},;|&=:\u201c\u201d\u00ab\u00bb\uff0c\uff1b\uff1a\u3001"
_EDGES = "\"'`<>[]{},;:!?#$%&*~^|"


class Field(NamedTuple):
    emit: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _space() -> np.ndarray:
    if "space" not in tx._cache:
        tx._cache["space"] = np.array([chr(c).isspace() for c in range(0x10000)] + [False] * 0x100000)
    return tx._cache["space"]


def _upper() -> np.ndarray:
    if "upper" not in tx._cache:
        tx._cache["upper"] = np.array([chr(c).isupper() for c in range(0x10000)] + [False] * (0x110000 - 0x10000))
    return tx._cache["upper"]


def _cuts(cps: np.ndarray) -> np.ndarray:
    """Where tokens are cut besides white space. An apostrophe between letters stays; ``(`` and ``)`` cut only after a letter."""
    if "cuts" not in tx._cache:
        tx._cache["cuts"] = np.isin(np.arange(0x110000), [ord(c) for c in _CUTS])
    letter = ((cps | 32) >= 97) & ((cps | 32) <= 122) | (cps >= 192)
    after, before = np.roll(letter, 1), np.roll(letter, -1)
    out = tx._cache["cuts"][cps] | (cps == 39) & ~(after & before) | ((cps == 40) | (cps == 41)) & after
    lines = np.flatnonzero(_space()[cps])
    at = np.flatnonzero(cps == 64)
    slash = np.flatnonzero(cps == 47)
    if len(at) and len(slash):  # addresses may be listed with slashes
        word = np.searchsorted(lines, at)
        out[slash[np.isin(np.searchsorted(lines, slash), word)]] = True
    return out


def _word(words: set[str]) -> np.ndarray:
    """Hashes of the words as they are written, capitalised and in capitals."""
    key = "words " + min(words)
    if key not in tx._cache:
        tx._cache[key] = np.unique(tx.hashed_as_they_are([f(w) for w in sorted(words) for f in (str, str.capitalize, str.upper)]))
    return tx._cache[key]


def _addresses(cps: np.ndarray) -> np.ndarray:
    """Colons that stand in a run of hexadecimal digits, colons and dots with two colons at least, apart from other letters."""
    if "hex" not in tx._cache:
        tx._cache["hex"] = np.isin(np.arange(0x110000), [ord(c) for c in "0123456789abcdefABCDEF:."])
    run = tx._cache["hex"][cps]
    edge = np.flatnonzero(np.diff(run.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    begin, end = edge[0::2], edge[1::2]
    colons = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(cps == 58, out=colons[1:])
    letter = tx.letters()[cps]
    apart = ~letter[begin - 1] | (begin == 0)
    apart &= ~letter[np.minimum(end, len(cps) - 1)]
    keep = apart & (colons[end] - colons[begin] >= 2)
    inside = np.zeros(len(cps) + 1, np.int8)
    np.add.at(inside, begin[keep], 1)
    np.add.at(inside, end[keep], -1)
    return (np.cumsum(inside[:-1]) > 0) & (cps == 58)


def _account(text: str) -> bool:
    """Whether an account number's check digits hold."""
    return len(text) >= 15 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def grouped(tokens: list[str]) -> tuple[str, int]:
    """Kind and number of leading tokens that are one card or account number in groups of four; ("", 0) for none."""
    if len(tokens) >= 4 and all(len(t) == 4 and t.isascii() and t.isdigit() for t in tokens[:4]) and _luhn("".join(tokens[:4])):
        return "CARD", 4
    best = 0
    if re.fullmatch(r"[A-Z]{2}\d{2}", tokens[0]):
        joined = tokens[0]
        for i, t in enumerate(tokens[1:], 2):
            if not re.fullmatch(r"[A-Z0-9]{1,4}", t) or len(joined) % 4 or len(joined) > 32:
                break
            joined += t
            best = i if _account(joined) else best
    return ("IBAN", best) if best else ("", 0)


def stripped(token: str) -> tuple[int, int]:
    """What is left of a token without punctuation at its edges."""
    a, b = 0, len(token)
    while a < b and (token[a] in _EDGES or token[a] == "(" and ")" not in token[a:b]):
        a += 1
    while a < b and (token[b - 1] in _EDGES or token[b - 1] == "." or token[b - 1] == ")" and "(" not in token[a:b]):
        b -= 1
    return a, b


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _ascii(x: str) -> str:
    return "".join(c for c in x if c in "0123456789")


#: Added to numbers of features where they stand on a group's node, and on a member of one.
_GROUP, _MEMBER = 1 << BITS, 2 << BITS


_LETTERS = re.compile(r"[^\W\d_]+")


def _cased(run: re.Match) -> str:
    return "A" if run[0].isupper() else "a"


def _number(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & (1 << BITS) - 1


def stripped_word(token: str) -> str:
    a, b = stripped(token)
    return token[a:b].lower()


def features(core: str, before: str, after: str, sign: bool, blank: bool, group: str = "", earlier: str = "") -> tuple[list[int], list[int], list[int]]:
    """Numbers of a node's features: those of the token itself, those of its surroundings, and again those of numbers there; ``before`` and ``after`` are the neighbouring tokens, ``sign`` and ``blank`` tell of a
    sign and of white space between the first and the node, ``group`` of what it is a part of;
    ``earlier`` is the token before ``before``."""
    shape = re.sub(r"\d", "9", core)
    short = _LETTERS.sub(_cased, re.sub(r"9+", lambda m: "9" * min(len(m[0]), 5), shape))
    digits = _ascii(core)
    octets = core.split(".")
    out = ["bias", "s" + short, "l" + str(min(len(core) // 4, 12)), "d" + str(min(len(digits), 20)), "a" + str(min(sum(c.isalpha() for c in core) // 4, 6))]
    plain = len(out)
    if len(octets) == 4 and all(o.isascii() and o.isdigit() and len(o) <= 3 and int(o) <= 255 for o in octets):
        out.append("octets")
    if re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s.]{2,}", core):
        out.append("address")
    if 13 <= len(digits) <= 19 and len(digits) + core.count("-") == len(core):
        out += ["number", "luhn" + str(_luhn(digits))]
    if re.fullmatch(r"[0-9a-fA-F]{16,}", core) and not core.isdigit():
        out.append("hex")
    if re.fullmatch(r"[A-Z0-9]{16,}", core) and not core.isdigit():
        out.append("capital key")
    if re.match(r"(?i)(AKIA|ASIA|sk[-_]|gh[pousr]_|xox|eyJ|AIza)", core):
        out += ["key head", f"key head {min(len(core) // 4, 12)}"]
    if re.fullmatch(r"\+\d{1,3}", core):
        out.append("country")
    if re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}", core):
        out.append(f"account {_account(core)}")
    if core.count(":") > 1:
        try:
            ipaddress.IPv6Address(core)
            out.append("address of six")
        except ValueError:
            pass
    if core[:1].isupper() and core.isalpha():
        out.append(f"capitalised {core[1:].islower()}")
    if group:
        out.append("group " + group)
    if len(out) == plain:
        out.append("no form")
    around = []
    cue = stripped_word(before)
    if cue == "is" and _KEY.search(earlier):
        around += ["key is", f"key is {core.isalpha()} {min(len(core) // 4, 12)}"]
    if cue in _TITLES:
        around.append("after title")
    if cue in _NAMED:
        around.append(f"after name {sign}")
    if cue in _CALLED:
        around.append("after call")
    if _KEY.search(before):
        around.append("after key" if sign else "after key word")
        if sign:
            around += [f"key {blank} {min(len(core) // 4, 12)}", f"key {blank} {core.isalpha()} {min(len(core) // 4, 12)}"]
    elif sign:
        around.append("after sign")
    beside = []
    for name, x in (("b", before), ("n", after)):
        y = re.sub(r"\d", "9", x)
        around.append(name + ("9" + _LETTERS.sub(_cased, y) if "9" in y else "none" if not x else "word"))
        if "9" in y:
            beside.append(around[-1])
    around += [f"{out[1]}|{around[-1]}", f"{out[1]}|{around[-2]}"]
    return [_number(x) for x in out], [_number(x) for x in around], [_number(x) for x in beside]


class Graph(NamedTuple):
    """Nodes in order of document and place, their features, and edges; chain edges come first in ``a`` and ``b``. ``run``: the
    end of the tokens that signs join to the node, or 0. Nodes from number ``real`` on stand for groups of equal tokens; their
    range is the first member's. ``part``: for parts of one number in groups its number, else -1."""

    text: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    rows: np.ndarray
    feature: np.ndarray
    a: np.ndarray
    b: np.ndarray
    chains: int
    run: np.ndarray
    real: int
    part: np.ndarray


def similar(core: str) -> list[str]:
    """Names under which a token meets those that share a potential with it."""
    plain = re.sub(r"[\W_]", "", core.lower())
    out = ["=" + (plain or core)]
    if "@" in core.strip("@"):
        out.append("@" + core.lower().rsplit("@", 1)[1])
    return out


def graph(texts: list[str | None]) -> Graph:
    cps, starts = tx.codepoints([t or "" for t in texts])
    space = _space()[cps]
    solid = ~space & (~_cuts(cps) | _addresses(cps))
    solid[starts[1:] - 1] = False
    edge = np.flatnonzero(np.diff(solid.view(np.int8), prepend=np.int8(0)))
    begin, end = edge[0::2], edge[1::2]
    mark = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(((cps >= 48) & (cps <= 57)) | (cps == 64), out=mark[1:])
    capital = np.zeros(len(cps) + 1, np.int64)
    np.cumsum((cps >= 65) & (cps <= 90), out=capital[1:])
    owner = np.searchsorted(starts, begin, "right") - 1

    def token(k: int, text: int) -> str:
        if not 0 <= k < len(begin) or owner[k] != text:
            return ""
        return texts[text][begin[k] - starts[text] : end[k] - starts[text]]

    def between(table: np.ndarray) -> np.ndarray:
        """How many such characters stand between a token and the one before it."""
        sums = np.zeros(len(cps) + 1, np.int64)
        np.cumsum(table, out=sums[1:])
        return sums[begin] - sums[np.r_[0, end[:-1]]] if len(begin) else np.zeros(0, np.int64)

    first = np.diff(owner, prepend=-1) != 0
    sign = (between((cps == 61) | (cps == 58) | (cps == 0xFF1A)) > 0) & ~first
    blank = between(space) > 0
    only = ~first & (between(~space) == 0)
    bare = sign & (np.r_[0, begin[1:] - end[:-1]][: len(begin)] == 1)
    strong = (mark[end] > mark[begin]) | (capital[end] - capital[begin] >= CAPITALS)
    bare_words = np.zeros(len(begin), bool)  # without a digit, so that their equals aren't nodes by themselves
    for k in np.flatnonzero(sign & ~strong).tolist():
        bare_words[k] = _KEY.search(token(k - 1, int(owner[k]))) is not None
    if len(begin):
        short = end - ((cps[end - 1] == 46) & (end - begin > 1))  # a full stop at the end aside
        name = tx.span_hashes(cps, begin, short)
        upper = _upper()[cps[begin]] & (mark[end] == mark[begin])
        before = np.roll(name, 1)
        person = upper & ~first & (only | (between(~space & (cps != 46)) == 0)) & np.isin(before, _word(_TITLES))
        person |= upper & sign & np.isin(before, _word(_NAMED))
        going = upper & only & ~first & ~np.roll(short != end, 1)
        for _ in range(2):  # up to three names
            person |= going & np.roll(person, 1)
        bare_words |= person
        for k in np.flatnonzero(only & np.isin(before, _word({"is"})) & ~strong).tolist():
            bare_words[k] = bare_words[k] or k > 1 and owner[k - 2] == owner[k] and _KEY.search(token(k - 2, int(owner[k]))) is not None
        key = tx.mixed(name + owner.astype(np.uint64) * np.uint64(tx.MIX))
        strong |= bare_words | np.isin(key, key[bare_words])
    part, kind_of = np.full(len(begin), -1), {}
    four = (end - begin == 4) & ~first & only
    digits = mark[end] - mark[begin]
    for k in np.flatnonzero((end - begin == 4) & (digits >= 2) & np.r_[four[1:], False] & np.r_[four[2:], False, False][: len(begin)]).tolist():
        if part[k] < 0:
            stop = k + 1
            while stop < min(len(begin), k + 9) and only[stop]:
                stop += 1
            kind, n = grouped([token(j, int(owner[k])).rstrip(".") for j in range(k, stop)])
            part[k : k + n] = k
            strong[k : k + n] = True
            if n:
                kind_of[k] = kind
    at = np.flatnonzero(strong)
    text, b0, e0, run, rows, feats, chain, skip = [], [], [], [], [], [], [], []
    groups: dict[tuple[int, str], list[int]] = {}
    each: list[tuple[list[int], list[int], list[int]]] = []
    previous = -2
    for k in at.tolist():
        t = int(owner[k])
        raw = token(k, t)
        x, y = stripped(raw)
        core = raw[x:y] or raw
        if not raw[x:y]:
            x, y = 0, len(raw)
        i = len(text)
        text.append(t)
        stop = k + 1
        while stop < len(begin) and bare[stop] and owner[stop] == t and not _KEY.search(token(stop - 1, t)):
            stop += 1
        run.append(int(end[stop - 1] - starts[t]) if stop > k + 1 else 0)
        b0.append(int(begin[k] - starts[t]) + x)
        e0.append(int(begin[k] - starts[t]) + y)
        f = features(core, token(k - 1, t), token(k + 1, t), bool(sign[k]), bool(blank[k]), kind_of.get(int(part[k]), ""), token(k - 2, t))
        each.append(f)
        if previous == k - 1 and only[k] and i and text[i - 1] == t:
            chain.append((i - 1, i))
        previous = k
        for same_as in similar(core) if part[k] < 0 else ():
            groups.setdefault((t, same_as), []).append(i)
    real = len(text)
    member = [False] * real
    for (t, name), own in groups.items():
        if len(own) < 2:
            continue
        g = len(text)
        text.append(t)
        b0.append(b0[own[0]])
        e0.append(e0[own[0]])
        run.append(0)
        skip += [(i, g) for i in own]
        same = set() if name[0] == "@" else {x for i in own for x in each[i][0]}
        f = [x ^ _GROUP for x in sorted(same | {x for i in own for x in each[i][1]} | {_number(name[0])})]
        rows += [g] * len(f)
        feats += f
        for i in own:
            member[i] = member[i] or name[0] == "="
    for i, (own, around, beside) in enumerate(each):
        f = [x ^ _MEMBER for x in beside] if member[i] else own + around
        rows += [i] * len(f)
        feats += f
    pairs = np.array([*chain, *skip], np.int64).reshape(-1, 2)
    return Graph(*(np.array(v, np.int64) for v in (text, b0, e0, rows, feats)), pairs[:, 0], pairs[:, 1], len(chain), np.array(run, np.int64), real, part[at])


def _normal(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` summed by ``at``."""
    return np.stack([np.bincount(at, values[:, k], minlength=n) for k in range(values.shape[1])], axis=1)


def _along(x: np.ndarray, chains: int, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Messages over edges, the first ``chains`` of them with the potential chain[from, to], the rest with skip on equal labels."""
    top = x[chains:].max(axis=1, keepdims=True)
    e = np.exp(x[chains:] - top)
    equal = np.log(e.sum(axis=1, keepdims=True) + np.expm1(skip) * e)
    near = np.log(np.exp(x[:chains] - x[:chains].max(axis=1, keepdims=True)) @ np.exp(chain)) if chains else x[:0]
    return _normal(np.concatenate([near, equal]))


def beliefs(g: Graph, field: Field, passes: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log marginals of nodes, marginals of chain edges, and of equal labels on skip edges, after so many rounds of message
    passing, or when it has settled."""
    n, m, labels = len(g.text), len(g.a), len(LABELS)
    unary = _sums(g.rows, field.emit[g.feature], n) if n else np.zeros((0, labels))
    forth, back = np.zeros((m, labels)), np.zeros((m, labels))
    total, live = unary.copy(), np.arange(m)  # the edges of documents that haven't settled
    step, done = 0.7, 0
    while len(live) and done != passes:
        a, b, chains = g.a[live], g.b[live], int(np.searchsorted(live, g.chains))
        f = step * (_along(total[a] - back[live], chains, field.chain, field.skip) - forth[live])
        r = step * (_along(total[b] - forth[live], chains, field.chain.T, field.skip) - back[live])
        forth[live] += f
        back[live] += r
        total = unary + _sums(g.b, forth, n) + _sums(g.a, back, n)
        done += 1
        if passes is None:
            still = np.zeros(int(g.text.max()) + 1, bool)
            still[g.text[a[np.maximum(np.abs(f), np.abs(r)).max(axis=1) > TOLERANCE]]] = True
            live = live[still[g.text[a]]]
        if done >= FIRM:
            step *= 0.9
    x, y = total[g.a] - back, total[g.b] - forth
    joint = x[: g.chains, :, None] + y[: g.chains, None, :] + field.chain
    p, q = np.exp(_normal(x[g.chains :])), np.exp(_normal(y[g.chains :]))
    same = np.exp(field.skip) * p * q
    same /= 1 + (np.expm1(field.skip) * p * q).sum(axis=1, keepdims=True)
    return _normal(total), np.exp(_normal(joint.reshape(g.chains, labels * labels))).reshape(g.chains, labels, labels), same


def examples(count: int = EXAMPLES, seed: int = 11) -> tuple[list[str], list[list[tuple[int, int, str]]]]:
    """Composed documents, and for each the (begin, end, label) of its entities' tokens."""
    rng = random.Random(seed)
    letters, hexa, caps = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567890"
    pick = lambda s, n: "".join(rng.choice(s) for _ in range(n))
    number = lambda n: pick("0123456789", n)
    word = lambda: pick(letters, rng.randint(1, 11))

    def email() -> list[tuple[str, str]]:
        if rng.random() < 0.2:
            return [(f"{word()}@{word()}.{rng.choice(['com', 'org', 'net', 'de', 'io'])}", "EMAIL")]
        return [(f"{word()}{rng.choice(['', '.', '_', '+'])}{rng.choice([word(), number(2), '.' + number(2)])}@{word()}{rng.choice(['', number(1)])}{rng.choice(['', '.' + word(), '.example'])}.{rng.choice(['com', 'org', 'net', 'de', 'io', 'co.uk'])}".replace("..", "."), "EMAIL")]

    def phone() -> list[tuple[str, str]]:
        form = rng.randrange(10)
        if form == 6:
            return [(f"({number(rng.randint(2, 5))})", "PHONE"), (number(rng.randint(5, 8)), "PHONE-I")]
        if form == 7:
            return [(rng.choice(["Tel", "tel.", "phone", "Telefon", "Fax", "call", "mobile"]), ""), (f"0{number(rng.randint(2, 3))}", "PHONE"), (number(rng.randint(5, 8)), "PHONE-I")]
        if form == 8:
            return [(f"+{number(2)}", "PHONE"), (number(rng.randint(2, 3)), "PHONE-I"), (number(rng.randint(6, 8)), "PHONE-I")]
        if form == 9:
            return [(rng.choice([f"0{number(3)}/{number(7)}", f"+{number(2)}.{number(3)}.{number(3)}.{number(3)}", f"{number(3)}.{number(3)}.{number(4)}"]), "PHONE")]
        if form < 3:
            return [(f"+{number(rng.randint(1, 2))}", "PHONE"), (f"({number(3)})", "PHONE-I"), (f"{number(3)}-{number(4)}", "PHONE-I")]
        if form == 3:
            return [(f"({number(3)})", "PHONE"), (f"{number(3)}-{number(4)}", "PHONE-I")]
        if form == 4:
            return [(rng.choice([f"{number(3)}-{number(3)}-{number(4)}", f"+1-{number(3)}-{number(3)}-{number(4)}", f"+{number(2)}{number(9)}"]), "PHONE")]
        return [(f"+{number(2)}", "PHONE"), (number(3), "PHONE-I"), (number(3), "PHONE-I"), (number(4), "PHONE-I")]

    def card() -> list[tuple[str, str]]:
        d = rng.choice("3456") + number(14)
        d += next(c for c in "0123456789" if _luhn(d + c)) if rng.random() < 0.7 else number(1)
        if _luhn(d) and rng.random() < 0.25:
            return [(d[i : i + 4], "CARD") for i in range(0, 16, 4)]
        return [(d if rng.random() < 0.8 else "-".join(d[i : i + 4] for i in range(0, 16, 4)), "CARD")]

    def account() -> list[tuple[str, str]]:
        land, body = pick(caps[:26], 2), rng.choice(["", pick(caps[:26], 4)]) + number(rng.randint(12, 20))
        check = 98 - int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        whole = f"{land}{check:02}{body}"
        if rng.random() < 0.5:
            return [(whole[i : i + 4], "IBAN") for i in range(0, len(whole), 4)]
        return [(whole, "IBAN")]

    def person() -> list[tuple[str, str]]:
        names = [(pick(letters, rng.randint(3, 9)).capitalize(), "PERSON") for _ in range(rng.randint(1, 3))]
        if rng.random() < 0.25:
            return [(rng.choice(["name", "Name", "customer", "contact", "full_name"]), ""), (rng.choice("=:"), "O"), *names]
        title = rng.choice(sorted(_TITLES))
        return [(rng.choice([title, title.capitalize()]) + rng.choice(["", "."]), ""), *names]

    def six() -> list[tuple[str, str]]:
        parts = [f"{rng.randrange(1 << 16):x}" for _ in range(8)]
        cut = rng.randint(1, 5)
        return [(rng.choice([":".join(parts), ":".join(parts[:cut]) + "::" + ":".join(parts[cut + 2 :]), "fe80::" + ":".join(parts[:4])]), "IP")]

    def secret() -> list[tuple[str, str]]:
        form = rng.randrange(11)
        key = rng.choice(["password", "passwd", "secret", "token", "api_key", "pwd", "auth_token", "access_key"])
        value = rng.choice([pick(hexa, rng.choice([18, 24, 32, 40])), pick(letters + caps, rng.randint(12, 40)) + number(2)])
        if form == 0:
            return [(rng.choice(["AKIA", "ASIA"]) + rng.choice([pick(caps, 15) + number(1), pick(caps[:26], 16)]), "SECRET")]
        if form in (1, 2):
            return [(f"{rng.choice(['password', 'passwd', 'secret', 'token', 'api_key', 'pwd'])}={value}", "SECRET")]
        if form in (3, 4):
            return [(rng.choice(["api_key", "secret_key", "token", "key"]), ""), (rng.choice(["=", "=", ":"]), "O"), (f'"{value}"', "SECRET")]
        if form == 10:
            return [(key, ""), ("is", ""), (rng.choice([value, pick(letters, rng.randint(12, 28)), pick(letters, 8) + number(2)]), "SECRET")]
        if form == 6:
            return [(f"{key}{rng.choice('=:')}{pick(letters, rng.randint(6, 24))}", "SECRET")]
        if form == 7:
            return [(key, ""), (rng.choice("=:"), "O"), (rng.choice(["{}", '"{}"']).format(pick(letters, rng.randint(12, 28))), "SECRET")]
        if form == 8:
            return [(f'"{key}":"{rng.choice([value, pick(letters, rng.randint(6, 24))])}"', "SECRET")]
        return [(rng.choice(["sk-", "ghp_", "xoxb-"]) + pick(letters + caps, 30) + number(1), "SECRET")]

    def other() -> list[tuple[str, str]]:
        return [(rng.choice([
            lambda: f"{rng.randint(1900, 2030)}", lambda: f"{rng.randint(1900, 2030)}-{number(2)}-{number(2)}", lambda: f"{number(1)}.{number(1)}", lambda: f"v{number(1)}.{number(1)}.{number(1)}", lambda: f"{number(1)}.{number(2)}.{number(1)}",
            lambda: f"${number(2)}.{number(2)}", lambda: f"{number(2)}%", lambda: f"{number(rng.randint(1, 7))}", lambda: f"({number(1)})", lambda: f"{number(1)}.", lambda: f"{word()}={word()}", lambda: f"{number(2)}:{number(2)}", lambda: f"{word()}{number(rng.randint(1, 3))}", lambda: f"{number(1)},{number(3)},{number(3)}",
            lambda: f"{number(2)}:{number(2)}:{number(2)}", lambda: f"{number(4)} {number(4)} {number(4)} {number(4)}", lambda: pick(caps[:26], 2) + number(18), lambda: f"{number(3)}-{number(3)}", lambda: f"{number(2)}-{number(2)}-{number(4)}", lambda: f"{number(1)}:{number(1)}:{number(1)}",
            lambda: " ".join(f"{x}{number(2)}" for x in [word()] * rng.randint(2, 5)), lambda: " ".join(pick(caps[:26], 2) + number(2) for _ in range(rng.randint(1, 3))),
            lambda: f"@{word()}", lambda: "=", lambda: "==", lambda: f"{number(2)}-{number(2)}", lambda: f"#{number(4)}", lambda: f"{number(9)}", lambda: f"x=={number(1)}", lambda: f"{pick(caps[:26], 3)}{number(3)}", lambda: f"https://{word()}.com/{word()}?page={number(1)}", lambda: f"{word()}-{number(2)}", lambda: f"+{number(2)}%", lambda: pick(caps[:26] * 4 + rng.choice(["", "ÓÉÜ"]), rng.randint(12, 24)) + rng.choice(["", "!!"]), lambda: pick(hexa, rng.choice([24, 32, 40])),
            lambda: f"{rng.choice(['secret', 'key', 'token', 'password', 'keyword', 'author'])}: {pick(letters, rng.randint(1, 9))} {word()}", lambda: f"{rng.choice(['secret', 'key', 'token', 'password'])} is {pick(letters, rng.randint(2, 9))}", lambda: f'"{word()}":"{word()}{number(2)}"', lambda: f"{word()}:{number(3)}",
        ])(), "O")]

    kinds = [email, phone, card, secret, secret, lambda: [(".".join(str(rng.randint(0, 255)) for _ in range(4)), "IP")], account, person, person, six, lambda: [(f"{number(3)}-{number(2)}-{number(4)}", "ID")]]
    texts, gold = [], []
    for _ in range(count):
        text, marks, again = "", [], []
        comma = rng.choice([",", '","', ";", "|", "&"]) if rng.random() < 0.25 else ""  # a line without blanks
        many = rng.random() < 0.07  # one thing named again and again
        for _ in range(rng.randint(12, 40) if many else rng.randint(4, 14)):
            repeat = bool(again) and rng.random() < (0.95 if many else 0.3)
            made = rng.choice(again) if repeat else rng.choice(kinds)() if rng.random() < 0.5 else [(pick(hexa, rng.choice([18, 24, 32, 40])), "O")] if many and rng.random() < 0.4 else other()
            if repeat and len(made) == 3 and made[2][1] == "SECRET":
                made = made[2:]  # named once, it may come back bare
            elif repeat and made[0][1] == "SECRET" and rng.random() < 0.5:
                made = [(re.split("[=:]", made[0][0])[-1].strip('"'), "SECRET")]
            elif repeat and made[-1][1] == "PERSON" and rng.random() < 0.7:
                made = [made[-1]]
            elif not repeat:
                again.append(made)
            for p, (tok, label) in enumerate(made):
                end = rng.choice(["", "", "", ".", ","]) if p == len(made) - 1 and label in ("EMAIL", "IP", "CARD", "IBAN", "ID", "PERSON") else ""
                if label:
                    cut = max(tok.rfind("=", 0, -1), tok.rfind(":", 0, -1)) + 1 if label == "SECRET" else 0
                    a, b = stripped(tok[cut:])
                    a, b = (a + cut, b + cut) if a < b else (0, len(tok))
                    marks.append((len(text) + a, len(text) + b, label))
                text += tok + (comma if comma and p == len(made) - 1 else end + rng.choice([" ", " ", "\n"]))
            if rng.random() < 0.85:
                text += (comma or " ").join(word() for _ in range(rng.randint(1, 6))) + (comma or rng.choice([" ", ". ", ", "]))
        texts.append(text)
        gold.append(marks)
    return texts, gold


@functools.cache
def train(count: int = EXAMPLES, steps: int = STEPS) -> Field:
    """The trained field; a process trains it once."""
    texts, gold = examples(count)
    g = graph(texts)
    used = np.unique(g.feature)
    g = g._replace(feature=np.searchsorted(used, g.feature))  # weights of features never seen stay 0
    known = {(t, a): LABELS.index(label) for t, marks in enumerate(gold) for a, _, label in marks}
    y = np.array([known.get((t, a), 0) for t, a in zip(g.text.tolist(), g.begin.tolist())])
    for i, group in zip(g.a[g.chains :].tolist(), g.b[g.chains :].tolist()):
        y[group] = y[group] or y[i]  # one that is an entity makes the group one
    n = len(LABELS)
    params = [np.zeros((len(used), n)), np.zeros((n, n)), np.zeros(n)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    chain, skip = slice(0, g.chains), slice(g.chains, None)
    for t in range(1, steps + 1):
        nodes, pairs, same = beliefs(g, Field(*params), 5)
        error = np.exp(nodes)
        error[np.arange(len(y)), y] -= 1
        emit = _sums(g.feature, error[g.rows], len(used))
        expected = pairs.sum(axis=0)
        np.add.at(expected, (y[g.a[chain]], y[g.b[chain]]), -1)
        agree = same.sum() - (y[g.a[skip]] == y[g.b[skip]]).sum()
        same = np.full(n, agree / n)  # one weight for all labels, so that mentions without evidence say nothing, however many
        for p, m, d in zip(params, moments, (emit, expected, same)):
            d = d / count + 1e-4 * p
            m[0], m[1] = 0.9 * m[0] + 0.1 * d, 0.99 * m[1] + 0.01 * d**2
            p -= 0.15 * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.99**t)) + 1e-9)
    emit = np.zeros((4 << BITS, n))
    emit[used] = params[0]
    return Field(emit, *params[1:])


def entities(texts: list[str | None], field: Field) -> list[tuple[int, int, int, str]]:
    """(text, begin, end, label) of every entity; the pieces of a telephone number, a name or a number in groups make one."""
    g = graph(texts)
    label = beliefs(g, field)[0].argmax(axis=1) if len(g.text) else []
    follows = set(g.b[: g.chains].tolist())
    out: list[tuple[int, int, int, str]] = []
    joined = -1
    for i, (t, a, b, k, more) in enumerate(zip(g.text[: g.real].tolist(), g.begin.tolist(), g.end.tolist(), label, g.run.tolist())):
        if k and out and out[-1][0] == t and a < out[-1][2]:
            continue  # inside a secret that went on
        name = LABELS[k].removesuffix("-I")
        goes_on = LABELS[k] == "PHONE-I" or name == "PERSON" and out and out[-1][3] == "PERSON" or i and g.part[i] >= 0 and g.part[i] == g.part[i - 1] and out and out[-1][3] == name
        if goes_on and i in follows and joined == i - 1:
            out[-1] = (t, out[-1][1], b, name)
            joined = i
        elif k:
            out.append((t, a, max(b, more) if name == "SECRET" else b, name))
            joined = i if name in ("PHONE", "PERSON", "CARD", "IBAN") else -1
    return out


def found(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, begin, end, label): character ranges of all entities."""
    held = docs.sparkSession.sparkContext.broadcast(field)

    def run(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in tx.batches(source, 1):
            got = entities(texts, held.value)
            rows = batch.column(0).take(pa.array([x[0] for x in got], pa.int64()))
            yield pa.RecordBatch.from_arrays([rows, pa.array([x[1] for x in got], pa.int32()), pa.array([x[2] for x in got], pa.int32()), pa.array([x[3] for x in got], pa.string())], ["doc_id", "begin", "end", "label"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, begin int, end int, label string")
