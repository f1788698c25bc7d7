"""Secret scans: fixed patterns, and a character convolutional network over every candidate and its context.

Three kinds of pattern give the base spans, leftmost and non-overlapping per kind; they always stay, and the network
says of each whether it doubts it. Candidates beside them are every run of 16 or more key characters with a digit or
mixed case, every value of 6 or more characters behind a name and a colon or equals sign, and the password of a URL.
The network reads a window of a candidate between the characters before and behind it, convolves their embeddings with
filters five characters wide, takes each filter's maximum and a logistic output. On a longer candidate the window
slides over every position; parts of 16 or more characters between its / = . are read each too, and the greatest answer
holds. It is trained in numpy on labelled findings made by rule - keys and passwords of many makes in assignments,
headers, URLs and prose against words, numbers, addresses, paths, dates, settings and checksums of files - that stand
in excerpts of the documents themselves (from `sample` documents to be expected, chosen by a hash; a documented bound).
One part of the findings is trained on, one calibrates the output (Platt scaling), and one sets the threshold that finds
the stated share of true secrets. A candidate that passes is added as kind `net`, unless a base span or another such
candidate covers it wholly.

Spans are code points, end exclusive. Null text counts as empty. Very long texts are scanned whole, in time that grows
with their length. Of equal spans one stays; spans with one start go by kind, then end. Equal texts have equal spans;
repeated rows are scanned each; an empty table gives no rows and is no less scanned by a network that has seen no
excerpt. Other columns, whatever their names, take no part in `scan`; `redact` keeps all columns.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.llm.common import map_arrow, map_whole, need

# The base patterns, with the least length of what they must hold.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "net")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")
PART = re.compile(r"[^/=.]{16,}")
NAMED = re.compile(r"""(?<![\w.-])[^\W\d][\w.-]{1,40}["']?[ \t]{0,2}[:=][ \t]{0,2}["']?([^\s"'<>,;]{6,})""")
IN_URL = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{0,20}://[^\s/:@]{1,80}:([^\s/@]{3,200})@")
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASIDE, HEAD, TAIL, FILTERS, WIDE, CLASSES, RECALL = 20, 20, 12, 24, 5, 48, 0.99
SAMPLE, FINDINGS, EXCERPT = 400, 12_000, 400
LENGTH = 2 * ASIDE + HEAD + TAIL


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    out = []
    low = text.lower()
    # lower-casing may lengthen a text but keeps every ASCII word
    if any(h in low for h in _HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of key characters, values of names and passwords of URLs, by start; none of plain words."""
    found = {m.span() for m in CANDIDATE.finditer(text) if _mixed(m[0])}
    if ":" in text or "=" in text:
        found.update(m.span(1) for m in NAMED.finditer(text) if _mixed(m[1]))
        found.update(m.span(1) for m in IN_URL.finditer(text))
    return sorted(found)


def _mixed(s: str) -> bool:
    return any(map(str.isdigit, s)) or (s[1:] != s[1:].lower() and s != s.upper())


def pieces(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Spans of a candidate that fit one window each: itself, or its parts where it is longer or has several."""
    out = [(start, end)] if end - start <= HEAD + TAIL else []
    for m in PART.finditer(text, start, end):
        if m.end() - m.start() <= HEAD + TAIL and m.span() != (start, end) and _mixed(m[0]):
            out.append(m.span())
    return out


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point below 256; others are one letter class."""
    names: list[str] = ["", *"0123456789abcdef", "g-z", "A-F", "G-Z", *"+/=_-.:;,'\"()[]{}<>@#%&$*|!?\\ \n"]
    index = {n: i for i, n in enumerate(names)}
    out = np.full(256, len(names), np.uint8)
    for c in range(128):
        ch = chr(c)
        key = ch if ch in index else "g-z" if ch.islower() else ("A-F" if ch in "ABCDEF" else "G-Z") if ch.isupper() else " "
        out[c] = index[key]
    return np.minimum(out, CLASSES - 1)


def window(text: str, start: int, end: int) -> str:
    """A candidate's ends between their context, one length for all."""
    before = text[max(0, start - ASIDE) : start].rjust(ASIDE, "\0")
    behind = text[end : end + ASIDE].ljust(ASIDE, "\0")
    if end - start >= HEAD + TAIL:
        return before + text[start : start + HEAD] + text[end - TAIL : end] + behind
    half = min(HEAD, end - start)
    return before + text[start : start + half].ljust(HEAD, "\0") + text[start + half : end].rjust(TAIL, "\0") + behind


def _codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = _classes()[np.minimum(c, 255)]
    x[c == 0] = 0
    x[c > 255] = CLASSES - 1
    return x


def encode(windows: list[str]) -> np.ndarray:
    return _codes("".join(windows)).reshape(len(windows), LENGTH)


def _greatest(a: np.ndarray, n: int) -> np.ndarray:
    """Greatest of each n rows in succession, by column."""
    m, w = a, 1
    while 2 * w <= n:
        m = np.maximum(m[:-w], m[w:])
        w *= 2
    k = len(a) - n + 1
    return np.maximum(m[:k], m[n - w : n - w + k])


class Network:
    """Embedding folded into the filters: a filter's answer at t is the sum of its weights for the classes around t."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.filters = rng.normal(0, 0.15, (WIDE, CLASSES, FILTERS)).astype(np.float32)
        self.offset = np.zeros(FILTERS, np.float32)
        # the same filters answer for the candidate and its context apart
        self.out = rng.normal(0, 0.3, (3 * FILTERS,)).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _zones(self) -> list[slice]:
        last = LENGTH - WIDE + 1
        return [slice(0, ASIDE - WIDE + 3), slice(ASIDE - WIDE + 3, ASIDE + HEAD + TAIL - 2), slice(ASIDE + HEAD + TAIL - 2, last)]

    def forward(self, x: np.ndarray):
        steps = LENGTH - WIDE + 1
        a = np.broadcast_to(self.offset, (len(x), steps, FILTERS)).copy()
        for o in range(WIDE):
            a += self.filters[o][x[:, o : o + steps]]
        peaks, tops = [], []
        for z in self._zones():
            top = a[:, z].argmax(axis=1) + z.start
            peaks.append(np.take_along_axis(a, top[:, None], axis=1)[:, 0])
            tops.append(top)
        h = np.concatenate(peaks, axis=1)
        return np.maximum(h, 0) @ self.out + self.bias[0], h, tops

    def slide(self, text: str, start: int, end: int, enough: float = np.inf, most: int = 4096) -> float:
        """Greatest answer over all windows of a candidate longer than one; the rest is left when one is enough."""
        x = _codes(text[max(0, start - ASIDE) : start].rjust(ASIDE, "\0") + text[start:end] + text[end : end + ASIDE].ljust(ASIDE, "\0"))
        best, n = -np.inf, len(x) - LENGTH + 1
        for i in range(0, n, most):
            part = x[i : i + most + LENGTH - 1]
            steps, k = len(part) - WIDE + 1, len(part) - LENGTH + 1
            a = np.broadcast_to(self.offset, (steps, FILTERS)).copy()
            for o in range(WIDE):
                a += self.filters[o][part[o : o + steps]]
            h = np.concatenate([_greatest(a[z.start : z.stop + k - 1], z.stop - z.start) for z in self._zones()], axis=1)
            best = max(best, float((np.maximum(h, 0) @ self.out).max() + self.bias[0]))
            if best >= enough:
                break
        return best

    def answers(self, texts: list[str], spans: list[tuple[int, int, int]], enough: float = np.inf) -> np.ndarray:
        """Greatest answer for each candidate (text, start, end)."""
        best = np.full(len(spans), -np.inf)
        owners, windows = [], []
        for j, (i, a, b) in enumerate(spans):
            for c, d in pieces(texts[i], a, b):
                owners.append(j)
                windows.append(window(texts[i], c, d))
        if windows:
            np.maximum.at(best, owners, self.logits(encode(windows)))
        for j, (i, a, b) in enumerate(spans):
            if b - a > HEAD + TAIL and best[j] < enough:
                best[j] = max(best[j], self.slide(texts[i], a, b, enough))
        return best

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 2048])[0] for i in range(0, len(x), 2048)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -30, 30)))

    def train(self, x: np.ndarray, y: np.ndarray, rounds: int, rate: float = 0.01, batch: int = 256, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        own = [self.filters, self.offset, self.out, self.bias]
        m, v, k = [np.zeros_like(p) for p in own], [np.zeros_like(p) for p in own], 0
        for _ in range(rounds):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                part = order[i : i + batch]
                z, h, tops = self.forward(x[part])
                d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)).astype(np.float32)
                dh = d[:, None] * self.out * (h > 0)
                g = [np.zeros_like(self.filters), dh.reshape(-1, 3, FILTERS).sum(axis=(0, 1)), np.maximum(h, 0).T @ d + 1e-4 * self.out, np.array([d.sum()], np.float32)]
                for zone, top in enumerate(tops):
                    dz = dh[:, zone * FILTERS : (zone + 1) * FILTERS]
                    for o in range(WIDE):
                        at = np.take_along_axis(x[part].astype(np.int64), top + o, axis=1) * FILTERS + np.arange(FILTERS)
                        g[0][o] += np.bincount(at.ravel(), dz.ravel(), minlength=CLASSES * FILTERS).reshape(CLASSES, FILTERS).astype(np.float32)
                k += 1
                for p, gp, a, b in zip(own, g, m, v, strict=True):
                    a += 0.1 * (gp - a)
                    b += 0.001 * (gp * gp - b)
                    p -= rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.999**k)) + 1e-7)

    def enough(self) -> float:
        """The least answer whose probability reaches the threshold."""
        return (np.log(self.threshold / (1 - self.threshold)) - self.shift) / self.scale

    def calibrate(self, z: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling of answers by Newton steps."""
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w = p * (1 - p) + 1e-6
            g = np.array([((p - y) * z).sum() + 1e-2 * (a - 1), (p - y).sum()])
            hess = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum()]])
            step = np.linalg.solve(hess, g)
            a, b = a - step[0], b - step[1]
        self.scale, self.shift = float(a), float(b)

    def choose(self, z: np.ndarray, y: np.ndarray, recall: float) -> None:
        """The greatest threshold with the recall asked for."""
        p = 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))
        self.threshold = float(np.quantile(p[y == 1], 1 - recall, method="lower"))


def made(n: int, seed: int = 11, contexts: tuple[str, ...] = ()) -> tuple[list[str], list[tuple[int, int]], np.ndarray]:
    """Labelled texts made by rule, with the place of the secret or of what looks like one, half of each.

    Most stand between words of the contexts, where there are any.
    """
    rng = np.random.default_rng(seed)
    pick = lambda s: s[rng.integers(len(s))]
    draw = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lower + upper + digits
    syllables = ["th", "er", "in", "on", "re", "an", "ti", "es", "en", "le", "de", "ou", "sch", "un", "ci", "ar", "qu", "el"]
    word = lambda: "".join(pick(syllables) for _ in range(rng.integers(1, 5)))
    given = [w for c in contexts if len(w := c.split(" ")) > 3]
    names = ["key", "auth", "bearer", "pwd", "access_key", "client_secret", "AWS_SECRET_ACCESS_KEY", "private_key", "credential", "authorization", "x-auth", "token", "secret"]
    locks = ["pwd", "pass", "pw", "passphrase", "passwort", "db_pass", "user_pwd", "admin_pass", "login.password", "PGPASSWORD", "kennwort", "contraseña", "mot_de_passe"]
    harmless_names = ["width", "color", "date", "time", "version", "file", "id", "user", "ref", "isbn", "phone", "tel", "host", "size", "page", "lang", "note", "from", "re", "src", "name", "mail", "build", "order"]
    symbols = "!#$%&*+-_?@"

    def prose() -> str:
        if given and rng.random() < 0.7:
            w = pick(given)
            at = rng.integers(0, max(1, len(w) - 6))
            return " ".join(w[at : at + 6])
        return " ".join(word() + pick(["", "", "", ",", "."]) for _ in range(6))

    def password() -> str:
        """What people think of: words with figures and signs in them."""
        base = "".join(word() for _ in range(2))[: rng.integers(4, 11)]
        if rng.random() < 0.5:
            base = base.title()
        if rng.random() < 0.5:
            base = base.translate(str.maketrans("aeio", "4310"))
        out = base + pick(["", pick(symbols), pick(symbols)]) + str(rng.integers(0, pick([10, 100, 10000]))) + pick(["", "", pick(symbols)])
        return out if len(out) >= 6 else out + draw(some, 6)

    def random_password() -> str:
        return draw(some + symbols, rng.integers(8, 20)) + pick(digits)

    def locked() -> tuple[str, str, str]:
        """A password where its name, or a URL, tells what it is."""
        s = pick([password, password, random_password])()
        name = pick(locks)
        name = pick([name, name, name.upper(), name.title()])
        if rng.random() < 0.35:
            s = s.replace("@", "-")
            scheme = pick(["postgres", "postgresql", "mysql", "redis", "amqp", "mongodb", "https", "ftp", "smtp"])
            return f"{prose()} {scheme}://{pick([word(), 'admin', 'root', 'app'])}:", s, f"@{word()}.example.com{pick(['', ':5432', ':3306'])}/{word()} {prose()}"
        a, b = pick([(": ", ""), ("=", ""), (" = '", "'"), ('="', '"'), (': "', '"'), (":", "")])
        return f"{prose()} {name}{a}", s, f"{b} {prose()}"

    def secret() -> tuple[str, str, str]:
        if rng.random() < 0.35:
            return locked()
        s = pick([
            lambda: draw(some, rng.integers(20, 48)),
            lambda: draw(some + "+/", 40),
            lambda: draw(some + "-_", rng.integers(24, 64)),
            lambda: draw(digits + "abcdef", pick([32, 40, 64])),
            lambda: pick(["ghp_", "gho_", "glpat-", "xoxb-", "sk_live_", "sk-", "sk-proj-", "rk_live_", "AIza", "SG.", "npm_", "hf_", "github_pat_", "xoxp-", "pypi-"]) + draw(some, rng.integers(20, 40)),
            lambda: "eyJ" + draw(some, 24) + "." + "eyJ" + draw(some, 30) + "." + draw(some + "-_", 30),
            lambda: draw(some + "+/", 43) + "=",
        ])()
        before, behind = pick([
            (lambda: (f"{pick(names)} = \"", '"')), (lambda: (f"{pick(names)}: ", "")), (lambda: (f"{prose()} ", f" {prose()}")),
            (lambda: ("Authorization: Bearer ", "\n")), (lambda: (f"export {pick(names).upper()}=", "\n")), (lambda: (f"{pick(names)}='", "'")),
            (lambda: (f"https://hooks.{word()}.example.com/services/T{draw(upper + digits, 8)}/B{draw(upper + digits, 8)}/", " ")), (lambda: (f"?{pick(names)}=", "&x=1")), (lambda: (f"https://{word()}.example.com/{word()}/{word()}/", f"/{word()}/{word()}.json ")),
            (lambda: (f"{word()}_{pick(names)}_{word()}=".upper(), " ")), (lambda: (f"{word()}/{word()}{rng.integers(1, 99)}/", f"/{word()} ")),
        ])()
        return f"{prose()} {before}", s, f"{behind} {prose()}"

    def setting() -> tuple[str, str, str]:
        """A value of a name that keeps no secret."""
        s = pick([
            lambda: f"{rng.integers(10, 2000)}px{rng.integers(1, 9)}", lambda: "#" + draw(digits + "abcdef", 6), lambda: f"{rng.integers(1950, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}",
            lambda: f"{rng.integers(10, 24)}:{rng.integers(10, 60)}:{rng.integers(10, 60)}", lambda: f"{rng.integers(1, 20)}.{rng.integers(0, 20)}.{rng.integers(0, 20)}{pick(['', '-rc1', '-beta2'])}",
            lambda: f"{word()}_{rng.integers(1990, 2030)}.{pick(['pdf', 'html', 'txt', 'png', 'csv'])}", lambda: draw(digits, rng.integers(6, 20)), lambda: f"{word()}{rng.integers(1, 100)}@{word()}.example.com",
            lambda: f"{pick(['+49', '+33', '001'])}-{draw(digits, 3)}-{draw(digits, 6)}", lambda: f"{draw(upper, 3)}-{draw(digits, 5)}", lambda: f"978-{draw(digits, 1)}-{draw(digits, 2)}-{draw(digits, 6)}-{draw(digits, 1)}",
            lambda: f"//{word()}.example.com:{rng.integers(80, 9000)}/{word()}", lambda: f"{word().title()}{word().title()}", lambda: f"{word()}-{word()}{rng.integers(1, 100)}", lambda: f"{word()}{rng.integers(1, 100)}",
        ])()
        name = pick(harmless_names) if rng.random() < 0.6 else word()
        a, b = pick([(": ", ""), ("=", ""), (" = '", "'"), ('="', '"'), (': "', '"'), (":", "")])
        return f"{prose()} {pick([name, name.title()])}{a}", s.ljust(6, "0"), f"{b} {prose()}"

    def harmless() -> tuple[str, str, str]:
        if rng.random() < 0.35:
            return setting()
        long = lambda k: "".join(word() for _ in range(k))
        s = pick([
            lambda: long(6)[:30].ljust(16, "e").capitalize() + pick(["", "2", "19"]),
            lambda: f"{word()}.{rng.integers(1, 99)}.{word()}-{word()}{rng.integers(1, 9)}.{word()}",
            lambda: draw(digits, 16), lambda: draw(digits, 16), lambda: f"{draw(digits, 16)} {draw(digits, 16)}",
            lambda: draw(digits, rng.integers(16, 20)),
            lambda: f"{long(rng.integers(1, 4))}.{rng.integers(1, 99)}@{word()}{rng.integers(1, 99)}.example.com",
            lambda: f"{rng.integers(1990, 2030)}-{rng.integers(10, 12)}-{rng.integers(10, 28)}T{rng.integers(10, 23)}-{rng.integers(10, 59)}",
            lambda: f"{word()}/{word()}/{word()}{rng.integers(1, 99)}/{word()}.html",
            lambda: f"{word()}_{word()}_{word()}_{rng.integers(1, 999)}".ljust(16, "s"),
            lambda: f"www.{long(2)}{rng.integers(1, 99)}.example.com/{word()}/{word()}",
            lambda: f"{pick(['camel', 'get', 'set', 'make'])}{word().title()}{word().title()}{word().title()}".ljust(16, "x"),
            lambda: "=" * rng.integers(16, 40) + str(rng.integers(9)),
            lambda: f"{draw(digits, 4)}-{draw(digits, 4)}-{draw(digits, 4)}-{draw(digits, 4)}",
            lambda: "/".join(word() + pick(["", "", str(rng.integers(1, 2030)), "_v2", "-" + word()]) for _ in range(rng.integers(4, 14))) + pick([".html", ".json", ".tar.gz", ""]),
            lambda: f"{word()}.example.com/{'/'.join(word() for _ in range(rng.integers(3, 9)))}/{rng.integers(1990, 2030)}/{rng.integers(1, 13)}/{'-'.join(word() for _ in range(rng.integers(2, 8)))}",
            lambda: f"{'_'.join(word() for _ in range(4))}={'-'.join(word() for _ in range(5))}.{rng.integers(1, 999)}".upper() if rng.random() < 0.3 else f"{word()}_{word()}={'.'.join(word() for _ in range(6))}{rng.integers(1, 99)}",
            lambda: "".join(word().title() for _ in range(rng.integers(4, 12))).ljust(16, "x"),
            lambda: f"{rng.integers(1, 9)}.{rng.integers(10, 99)}.{rng.integers(100, 999)}-{word()}{rng.integers(1, 9)}-{word()}",
        ])()
        before, behind = pick([(lambda: (" ", " ")), (lambda: ("https://", " ")), (lambda: ("(", ")")), (lambda: ("sha of the file: " if rng.random() < 0.1 else " ", ".")), (lambda: ("@", ", ")), (lambda: ('"', '"'))])()
        return f"{prose()}{before}", s, f"{behind}{prose()}"

    texts, places, y = [], [], np.arange(n) % 2 == 0
    for positive in y:
        a, s, b = secret() if positive else harmless()
        texts.append(a + s + b)
        places.append((len(a), len(a) + len(s)))
    return texts, places, y.astype(np.float32)


def reach(texts: list[str], places: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The candidates (text, start, end) that touch the places."""
    return [(i, a, b) for i, (t, (c, d)) in enumerate(zip(texts, places, strict=True)) for a, b in candidates(t) if a < d and c < b]


def findings(n: int, seed: int = 11, each: int = 2, contexts: tuple[str, ...] = ()) -> tuple[list[str], np.ndarray]:
    """Labelled windows of the candidates in made texts: some of those that lie in the secret, or of all."""
    texts, places, y = made(n, seed, contexts)
    rng = np.random.default_rng(seed + 1)
    full, windows, labels = HEAD + TAIL, [], []
    for i, a, b in reach(texts, places):
        seen = pieces(texts[i], a, b) + [(p, p + full) for p in range(a, b - full + 1)]
        if y[i]:
            c, d = places[i]
            seen = [s for s in seen if min(s[1], d) - max(s[0], c) >= min(s[1] - s[0], d - c)]
        # of what is harmless, more: none of a long run's windows may pass
        for j in rng.permutation(len(seen))[: each if y[i] else 3 * each]:
            windows.append(window(texts[i], *seen[j]))
            labels.append(y[i])
    return windows, np.array(labels, np.float32)


def excerpts(docs: DataFrame, sample: int = SAMPLE, length: int = EXCERPT) -> tuple[str, ...]:
    """Pieces of `length` code points, at places chosen by a hash, of about `sample` documents: the bound of what is collected."""
    texts = docs.select(F.col("text").alias("t")).where("t is not null and t <> ''")
    n = texts.count()
    if not n:
        return ()
    h = F.xxhash64("t")
    part = texts.where(F.pmod(h, F.lit(1 << 30)) < min(1.0, sample / n) * (1 << 30)).groupBy("t").count().select("t")
    at = F.pmod(F.shiftright(h, 32), F.greatest(F.lit(1), F.char_length("t") - length)) + 1
    return tuple(sorted(r[0] for r in part.select(F.substring(F.col("t"), at.cast("int"), F.lit(length))).collect()))


@lru_cache(maxsize=2)
def model(n: int = FINDINGS, recall: float = RECALL, contexts: tuple[str, ...] = ()) -> Network:
    """The trained, calibrated network for these contexts: three fifths of the findings train it, one calibrates, one sets the threshold."""
    w, y = findings(n * 3 // 5, 11, 2, contexts)
    net = Network()
    net.train(encode(w), y, 8)

    def judged(seed: int) -> tuple[np.ndarray, np.ndarray]:
        """The best answer within each made text, and its label."""
        texts, places, labels = made(n // 5, seed, contexts)
        spans = reach(texts, places)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, [i for i, _, _ in spans], net.answers(texts, spans))
        return best[best > -np.inf], labels[best > -np.inf]

    net.calibrate(*judged(12))
    net.choose(*judged(13), recall)
    return net


def fit(docs: DataFrame, sample: int = SAMPLE) -> Network:
    """The network trained on findings in excerpts of the documents."""
    return model(contexts=excerpts(docs, sample))


def spans_of(texts: list[str | None], net: Network) -> tuple[list[list[tuple[int, int, str]]], list[int]]:
    """All spans of each text, by start, then kind; and how many of its base spans the network doubts."""
    texts = [t or "" for t in texts]
    out = [base_spans(t) for t in texts]
    doubted = [0] * len(texts)
    where = [(i, a, b, k) for i, (t, base) in enumerate(zip(texts, out, strict=True)) for a, b, k in [*base, *((a, b, "net") for a, b in candidates(t))]]
    if where:
        enough = net.enough()
        touched = set()
        for (i, a, b, k), ok in zip(where, (net.answers(texts, [w[:3] for w in where], enough) >= enough).tolist(), strict=True):
            if k != "net":
                doubted[i] += not ok
            elif ok:
                out[i].append((a, b, "net"))
                touched.add(i)
        for i in touched:
            out[i] = _uncovered(out[i])
    return out, doubted


def _uncovered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The base spans and those net spans that no other span covers wholly, by start, then kind."""
    spans.sort(key=lambda s: (s[0], -s[1], s[2] == "net"))
    kept, reached = [], -1
    for a, b, k in spans:
        if k != "net" or b > reached:
            kept.append((a, b, k))
        reached = max(reached, b)
    return sorted(kept, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(df: DataFrame, net: Network | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_net, n_doubted) of each whole text."""
    net = net or fit(df)

    def run(cols: dict[str, list]) -> dict[str, list]:
        found, doubted = spans_of(cols["text"], net)
        base = [[s for s in f if s[2] != "net"] for f in found]
        count = lambda kind: [sum(s[2] == kind for s in f) for f in found]
        return {
            "doc_id": cols["doc_id"], "n_assign": count("assign"), "n_access": count("access"), "n_hex": count("hex"),
            "base_sha256": [hashlib.sha256(written(b).encode()).hexdigest() for b in base], "spans": [written(f) for f in found], "n_net": count("net"), "n_doubted": doubted,
        }

    return map_arrow(need(df, "doc_id", "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_net long, n_doubted long", 1024)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each run of overlapping spans replaced by a mark."""
    out, at = [], 0
    merged: list[list] = []
    for a, b, k in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    for a, b, k in merged:
        out += [text[at:a], f"[{k}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(df: DataFrame, net: Network | None = None) -> DataFrame:
    """df, all rows and columns, with secrets in text replaced; n_chars follows where there is such a column."""
    net = net or fit(df)

    def change(part):
        import pyarrow as pa

        texts = part.column("text").to_pylist()
        new = [t if not s else redacted(t, s) for t, s in zip(texts, spans_of(texts, net)[0], strict=True)]
        cols = {name: part.column(name) for name in part.schema.names}
        cols["text"] = pa.array(new, part.schema.field("text").type)
        if "n_chars" in cols:
            old = cols["n_chars"].to_pylist()
            cols["n_chars"] = pa.array([o if x is t else len(x) for o, x, t in zip(old, new, texts, strict=True)], part.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays([*cols.values()], names=[*cols])

    return map_whole(df, change)
