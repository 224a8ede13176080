"""Secret scans: patterns, and two character Markov models compared by log-likelihood ratio."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import import_module

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from launchlens.llm import words as W

# The base kinds in their order, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX_LEAST, ACCESS_LEAST, VALUE_LEAST = 32, 16, 8

#: Kind of the spans that the models add; it comes after the base kinds.
MODEL_KIND = "random"
#: Characters of a token: letters, digits and these. Class 0 is any other byte.
TOKEN_MARKS = b"+/_-"
#: Shortest token that the models learn from, and the shortest one they judge.
LEARN_LEAST, JUDGE_LEAST = 4, 16
#: Odds by which a token must more likely be random than ordinary, on top of how much rarer secrets are among the samples.
ODDS = 1e6


def token_classes() -> np.ndarray:
    """Class of every byte: letters, digits and TOKEN_MARKS numbered from 1, the rest 0."""
    table = np.zeros(256, np.int64)
    inside = [b for b in range(128) if chr(b).isalnum() or b in TOKEN_MARKS]
    table[inside] = np.arange(1, len(inside) + 1)
    return table


N_CLASSES = int(token_classes().max()) + 1


def edges(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    change = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
    return change[::2], change[1::2]


HEX_BYTES = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))


def base_spans(text: bytes, hex_runs: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) in bytes of the base matches; `hex_runs` are the text's long runs of hex digits."""
    found = [(a, 2, b, a) for a, b in hex_runs]
    low = text.lower()
    # a match holds one of these, and they are quick to look for
    if any(k in low for k in (b"passw", b"secret", b"token", b"apikey", b"api_key")):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= VALUE_LEAST]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return sorted(found)


@dataclass
class Block:
    """Texts of a block joined by line feeds, with their base spans and the classes of their bytes outside of them."""

    data: np.ndarray
    first: np.ndarray
    base: list[list[tuple[int, int, int, int]]]
    cls: np.ndarray


def read_block(texts: list[bytes]) -> Block:
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    lo, hi = edges(HEX_BYTES[data])
    long = hi - lo >= HEX_LEAST
    lo, hi = lo[long], hi[long]
    at = np.searchsorted(first, lo, "right") - 1
    runs: list[list[tuple[int, int]]] = [[] for _ in texts]
    for a, b, d in zip(lo.tolist(), hi.tolist(), at.tolist(), strict=True):
        runs[d].append((a - int(first[d]), b - int(first[d])))
    base = [base_spans(t, r) for t, r in zip(texts, runs, strict=True)]
    cls = token_classes()[data]
    for d, spans in enumerate(base):
        for a, _, b, _ in spans:
            cls[first[d] + a : first[d] + b] = 0
    return Block(data, first, base, cls)


def trigram_codes(cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokens, and for each byte of one the code of (two characters before, it) with 0 before the token."""
    lo, hi = edges(cls > 0)
    before = np.concatenate([[0], cls])[: len(cls)]
    before2 = np.concatenate([[0, 0], cls])[: len(cls)]
    # the character before the first one of a token has class 0; the one before that may belong to another token
    before2[before == 0] = 0
    return lo, hi, (before2 * N_CLASSES + before) * N_CLASSES + cls


def count_tokens(cls: np.ndarray) -> tuple[np.ndarray, int]:
    """Counts of the trigram codes of all tokens of LEARN_LEAST characters or more, and the number of the ones that models judge."""
    lo, hi, codes = trigram_codes(cls)
    long = hi - lo >= LEARN_LEAST
    mark = np.zeros(len(cls) + 1, np.int8)
    mark[lo[long]] += 1
    mark[hi[long]] -= 1
    inside = np.cumsum(mark[:-1]) > 0
    return np.bincount(codes[inside], minlength=N_CLASSES**3), int((hi - lo >= JUDGE_LEAST).sum())


def judged_tokens(cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokens long enough to be judged, the places of their bytes, where each begins among those, and their codes."""
    lo, hi, codes = trigram_codes(cls)
    long = hi - lo >= JUDGE_LEAST
    lo, hi = lo[long], hi[long]
    size = hi - lo
    starts = np.concatenate([[0], np.cumsum(size)])[:-1]
    place = np.repeat(lo - starts, size) + np.arange(size.sum())
    return lo, hi, place, starts, codes[place]


#: Log-likelihood ratio of the fixed models per character from which a token is no sample of ordinary ones.
UNLABELLED = 1.5

SAMPLES = "secret boolean, code int, n long"
#: Code under which the number of tokens is counted.
TOKENS = -1


def labelled_counts(docs: DataFrame) -> DataFrame:
    """(secret, code, n): trigram counts of the labelled samples of every whole text, summed in Spark.

    The values of base matches are labelled secret, all other tokens ordinary, but for long ones that the two fixed
    models find random by UNLABELLED a character: those would teach the ordinary model themselves. A task sends one row
    per code it met, N_CLASSES ** 3 at most. Null texts are empty.
    """
    drawn, named = fixed_models()
    source = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = token_classes()
        totals = np.zeros((2, N_CLASSES**3), np.int64)
        tokens = [0, 0]
        for block in W.blocks(W.arrow_rows(batches, "text"), 0):
            b = read_block([t for (t,) in block])
            values = [t[v:e] for (t,), spans in zip(block, b.base, strict=True) for _, _, e, v in spans]
            known = table[np.frombuffer(b"\n".join(values), np.uint8)]
            lo, hi, place, starts, codes = judged_tokens(b.cls)
            if len(lo):
                doubtful = np.add.reduceat(drawn[codes] - named[codes], starts) > UNLABELLED * (hi - lo)
                b.cls[place[np.repeat(doubtful, hi - lo)]] = 0
            for secret, cls in ((0, b.cls), (1, known)):
                n, k = count_tokens(cls)
                totals[secret] += n
                tokens[secret] += k
        for secret in (0, 1):
            at = np.flatnonzero(totals[secret])
            code = np.concatenate([[TOKENS], at]).astype(np.int32)
            n = np.concatenate([[tokens[secret]], totals[secret][at]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at) + 1, bool(secret))), pa.array(code), pa.array(n)], names=["secret", "code", "n"])

    return source.mapInArrow(run, SAMPLES).groupBy("secret", "code").agg(F.sum("n").alias("n"))


def sample_counts(samples: DataFrame) -> DataFrame:
    """The same counts from the caller's own labelled samples: columns sample (string) and secret (boolean); null ones are left out."""
    texts = samples.where("sample is not null and secret is not null").select("secret", F.col("sample").cast("binary").alias("sample"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = token_classes()
        for rows in W.blocks(W.arrow_rows(batches, "secret", "sample"), 1):
            for secret in (False, True):
                n, k = count_tokens(table[np.frombuffer(b"\n".join(s for label, s in rows if label == secret), np.uint8)])
                at = np.flatnonzero(n)
                code = np.concatenate([[TOKENS], at]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at) + 1, secret)), pa.array(code), pa.array(np.concatenate([[k], n[at]]))], names=["secret", "code", "n"])

    return texts.mapInArrow(run, SAMPLES).groupBy("secret", "code").agg(F.sum("n").alias("n"))


#: Alphabets of the random strings that are labelled secret in every fit, strings drawn from each, and their length.
ALPHABETS = (
    "0123456789abcdef", "0123456789ABCDEF", string.ascii_uppercase + "234567", string.ascii_letters + string.digits,
    string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_",
)
DRAWN, DRAWN_LENGTH = 500, 32


#: Modules of Python's library whose public names are labelled ordinary in every fit.
NAMED = ("argparse", "asyncio", "calendar", "collections", "configparser", "datetime", "decimal", "difflib", "email.message", "http.client", "inspect", "json", "locale", "logging", "os", "pathlib", "shutil", "signal", "socket", "statistics", "subprocess", "tarfile", "threading", "traceback", "unittest", "urllib.request", "xml.dom.minidom", "zipfile")


def random_strings() -> list[str]:
    """Strings drawn from each alphabet, the same in every run."""
    rng = np.random.default_rng(11)
    return ["".join(row) for a in ALPHABETS for row in rng.choice(list(a), size=(DRAWN, DRAWN_LENGTH))]


def ordinary_names() -> list[str]:
    """Names of the library as they are, in capitals, in pairs and as paths, and plain numbers and dates."""
    names = set()
    for module in map(import_module, NAMED):
        for name, value in vars(module).items():
            names |= {name, *(vars(value) if isinstance(value, type) else ())}
    plain = sorted(n for n in names if len(n) >= LEARN_LEAST and not n.startswith("_"))
    rng = np.random.default_rng(12)
    a, b = (rng.choice(plain, len(plain)) for _ in range(2))
    out = plain + [n.upper() for n in plain]
    for sep in ("_", "/", "-", ""):
        out += [f"{x}{sep}{y[:1].upper() + y[1:] if not sep else y}" for x, y in zip(a.tolist(), b.tolist())]
    days = [f"{y}-{m:02}-{d:02}T{h:02}-{m * 4:02}-{d:02}" for y in range(1995, 2030) for m, d, h in ((1, 9, 7), (6, 15, 12), (11, 28, 23))]
    return out + days + ["".join(row) for row in rng.choice(list("0123456789"), size=(DRAWN, 16))]


def sample_trigrams(samples: list[str]) -> np.ndarray:
    return count_tokens(token_classes()[np.frombuffer("\n".join(samples).encode(), np.uint8)])[0]


def _level(seen: np.ndarray, above: np.ndarray, weight: float) -> np.ndarray:
    """Shares of the counts, drawn towards those of the level above, which weigh as much as `weight` observations."""
    return (seen + weight * above) / (seen.sum(axis=-1, keepdims=True) + weight)


def _uniform() -> np.ndarray:
    out = np.full(N_CLASSES, 1 / (N_CLASSES - 1))
    out[0] = 0.0
    return out


def _logs(p: np.ndarray) -> np.ndarray:
    # no token holds class 0, so its codes never count
    return np.log(np.where(p > 0, p, 1.0)).reshape(-1)


def random_model(seen: np.ndarray) -> np.ndarray:
    """Log-probabilities by trigram code: order 1 over the uniform distribution, which weighs N_CLASSES observations."""
    k = N_CLASSES
    order1 = _level(seen.sum(axis=0), np.broadcast_to(_uniform(), (k, k)), float(k))
    return _logs(np.broadcast_to(order1, (k, k, k)))


def ordinary_model(seen: np.ndarray) -> np.ndarray:
    """Log-probabilities by trigram code: order 2 over order 1 over order 0 over the uniform one, each weighing N_CLASSES / 4 observations."""
    k = N_CLASSES
    p = _level(seen.sum(axis=(0, 1)), _uniform(), k / 4)
    p = _level(seen.sum(axis=0), np.broadcast_to(p, (k, k)), k / 4)
    return _logs(_level(seen, np.broadcast_to(p, (k, k, k)), k / 4))


def fixed_models() -> tuple[np.ndarray, np.ndarray]:
    """The models of the drawn strings and of the ordinary names."""
    drawn, named = (sample_trigrams(x).reshape((N_CLASSES,) * 3) for x in (random_strings(), ordinary_names()))
    return random_model(drawn), ordinary_model(named)


@dataclass(frozen=True)
class Models:
    """Log-probabilities of a character after two others, by trigram code, and the ratio a token needs.

    Two models of random strings, of the labelled ones and of drawn ones, and two of ordinary
    tokens, of the labelled ones and of library names.
    """

    random: tuple[np.ndarray, np.ndarray]
    ordinary: tuple[np.ndarray, np.ndarray]
    needed: float

    def score(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log-likelihood ratio of tokens, the two models of a side being equally likely."""
        r, o = (np.logaddexp(*(np.add.reduceat(m[codes], starts) for m in side)) for side in (self.random, self.ordinary))
        return r - o


def fit(counts: DataFrame, odds: float = ODDS) -> Models:
    """All models from the trigram counts; what reaches the driver is at most 2 * N_CLASSES ** 3 rows of counts.

    Random strings have one model of the labelled secrets and one of strings drawn from the usual alphabets, since secrets of one
    alphabet may be all that is labelled; ordinary tokens one of the labelled ones and one of the names, numbers
    and dates of `ordinary_names`.
    A token is random if its ratio exceeds log(odds * ordinary tokens / secret tokens), both counted, and one added,
    among the samples that are long enough to be judged.
    """
    k = N_CLASSES
    n = np.zeros((2, k, k, k))
    tokens = [0, 0]
    for row in counts.collect():
        if row["code"] == TOKENS:
            tokens[row["secret"]] = row["n"]
        else:
            n[int(row["secret"])].reshape(-1)[row["code"]] = row["n"]
    drawn, named = fixed_models()
    needed = float(np.log(odds) + max(np.log((tokens[0] + 1) / (tokens[1] + 1)), 0.0))
    return Models((random_model(n[1]), drawn), (ordinary_model(n[0]), named), needed)


def block_spans(texts: list[bytes], models: Models) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text the base spans and the ones that the models add, as (start, kind, end) in bytes."""
    b = read_block(texts)
    lo, hi, _, starts, codes = judged_tokens(b.cls)
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if len(lo):
        hit = models.score(codes, starts) > models.needed
        lo, hi = lo[hit], hi[hit]
        for a, e, d in zip(lo.tolist(), hi.tolist(), (np.searchsorted(b.first, lo, "right") - 1).tolist(), strict=True):
            added[d].append((a - int(b.first[d]), len(KINDS), e - int(b.first[d])))
    return [([s[:3] for s in base], more) for base, more in zip(b.base, added, strict=True)]


SPANS = "_keys struct<>, base array<struct<start:long,kind:string,end:long>>, added array<struct<start:long,kind:string,end:long>>"


def scan(docs: DataFrame, models: Models, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """_keys (a struct of the columns `keys`), base and added: spans of every whole text in code points, end exclusive.

    Both are sorted by start, then kind as listed. Added spans never meet base ones: the bytes of base
    spans end a token.
    """
    source = docs.select(F.struct(*keys).alias("_keys"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    types = SPANS.replace("struct<>", source.schema["_keys"].dataType.simpleString())
    names = (*KINDS, MODEL_KIND)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
        for batch in batches:
            columns: tuple[list, list] = ([], [])
            for block in W.blocks(W.arrow_rows([batch.select([1])], "text"), 0):
                texts = [t for (t,) in block]
                for text, both in zip(texts, block_spans(texts, models), strict=True):
                    points = _points(text) if both[0] or both[1] else None
                    for out, spans in zip(columns, both, strict=True):
                        out.append([{"start": points[a], "kind": names[k], "end": points[e]} for a, k, e in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, span) for c in columns)], names=["_keys", "base", "added"])

    return source.mapInArrow(run, types)


def _points(text: bytes):
    """Code points before each byte offset."""
    if text.isascii():
        return range(len(text) + 1)
    data = np.frombuffer(text, np.uint8)
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]).tolist()


def find_secrets(docs: DataFrame, samples: DataFrame | None = None, odds: float = ODDS, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Secrets of every whole text: a struct _keys, base and added spans (see `scan`).

    Base spans are the leftmost matches, not overlapping within a kind, of `ASSIGN` with a value of 8 characters or more, of
    `ACCESS` with 16 or more, and runs of 32 or more lower-case hex digits; letters of A-Z and a-z only fold for each other. The
    span is the whole match. The models learn from `samples` (sample, secret) or, without them, from every text: values of
    base matches as secrets, all other tokens as ordinary. They judge every token of 16 or more characters outside the base spans.

    Null texts are empty: no spans. Null ids and repeated rows stay as rows of their own; an empty
    table gives no rows; other columns are ignored. A text is read whole, in blocks of about 1 MB; a longer one is
    a block of its own.
    """
    counts = labelled_counts(docs) if samples is None else sample_counts(samples)
    return scan(docs, fit(counts, odds), keys)


def span_digests(found: DataFrame) -> DataFrame:
    """The columns of the registered query: counts by base kind, the digest of the base spans, and all spans as a string."""

    def written(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    # base spans come before added ones that start at the same place; there are none, since they never meet
    ordered = F.array_sort(F.concat("base", "added"), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(_listed(a["kind"]) - _listed(b["kind"])))
    return found.select(
        "_keys.*",
        *[count(k) for k in KINDS],
        F.sha2(written("base").cast("binary"), 256).alias("base_sha256"),
        ordered.alias("_all"),
    ).withColumn("spans", written("_all")).drop("_all")


def _listed(kind: Column) -> Column:
    out = F.lit(len(KINDS))
    for n, name in enumerate(KINDS):
        out = F.when(kind == name, F.lit(n)).otherwise(out)
    return out

