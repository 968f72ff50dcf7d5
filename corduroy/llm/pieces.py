"""SentencePiece merge-type encoding and decoding (operator 10).

The model's pieces and scores are read once a worker; encoding is our own. A text becomes "▁" + text with every space as "▁". No
piece of a supported model has "▁" after another character, so a text is cut before each run of "▁" and each cut part is encoded
on its own and remembered. A part is encoded by backtracking: the automaton gives the longest piece at a position, a piece is kept
if re-merging it with the piece before it leaves the two apart, a bitfield holds the positions from which no ending was found, and
shorter pieces or the piece before are tried next. No more than the longest piece's length is looked ahead, so memory is in
proportion to the text. Characters in no piece become their bytes' pieces.

Nulls and ties: a null text is empty (no ids); rows with equal doc_id are all returned. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_for_a_partition, map_rows, table

#: Entries of each of a worker's memos (encoded words, and as many old ones; compared neighbours), some 45 MB at most each: words
#: have fewer than WORD_CHARS characters, pieces are short. All are emptied at a partition's end.
MEMO_LIMIT, WORD_CHARS = 200_000, 64
SPACE = "▁"
#: Texts that other normalisers change; a model that encodes them otherwise is not supported.
PROBES = (" a  b ", "ﬁ ① Ａ", "e\u0301 é", "\ta\n b\u3000c", "ÀB ß")

_loaded: dict = {}


class PieceCodec:
    """encode(text) -> ids and decode(ids) -> text, exactly as the library's for a merge-type model with byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.piece, self.bytes, score = [], {}, {}
        for i in range(model.get_piece_size()):
            text = model.id_to_piece(i)
            self.piece.append(text)
            if model.is_byte(i):
                self.bytes[int(text[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                score[text] = model.get_score(i), i
        if any(SPACE in x.lstrip(SPACE) for x in score):
            raise ValueError("pieces with white space after other characters are not supported")
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.special = {i for i in range(len(self.piece)) if model.is_control(i)}
        self.unknown = {i for i in range(len(self.piece)) if model.is_unknown(i)}
        self.id = {x: i for x, (_, i) in score.items()}
        order = sorted(score, key=lambda x: (-score[x][0], score[x][1]))
        self.decimal = {x: str(i) for x, i in self.id.items()}
        self.shown = {x: x.replace(SPACE, " ") for x in self.id}
        self.rank = {x: n for n, x in enumerate(order)}
        #: Equal scores merge by place, so they share the first one's rank for merging.
        self.level, last = {}, None
        for n, x in enumerate(order):
            if last is None or score[x][0] != score[last][0]:
                last = x
            self.level[x] = self.rank[last]
        self.part = {}
        self.automaton = ahocorasick.Automaton()
        for x in order:
            if len(x) == 1:
                self.part[x] = None
            elif (m := self._last_merge(x)) is not None:
                self.part[x] = m
        for x in self.part:
            self.automaton.add_word(x, x)
        self.automaton.make_automaton()
        self.ahead = max(map(len, self.part))
        self.shorter = {x: next((x[:n] for n in range(len(x) - 1, 0, -1) if x[:n] in self.part), None) for x in self.part}
        self.memo: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.apart: dict[tuple[str, str], bool] = {}
        #: The longest piece that each beginning of a piece begins with.
        self.longest: dict[str, str] = {}
        for x in sorted(self.part, key=len):
            for n in range(1, len(x) + 1):
                start = x[:n]
                if start in self.part:
                    self.longest[start] = start
                elif start not in self.longest:
                    self.longest[start] = self.longest.get(x[: n - 1], x[0])
        if any(self.encode(x) != model.encode(x) for x in PROBES):
            raise ValueError("the model's normaliser is another than white space to ▁ with one in front")

    def _merge(self, text: str, log: list | None = None) -> list[str]:
        """Merge neighbours, best score first and leftmost among equals, until no pair is a piece."""
        parts = list(text)
        level = self.level
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = level.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            if log is not None:
                log.append((parts[at], parts[at + 1]))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _last_merge(self, text: str):
        """The pair whose merge makes the piece; None for a piece that merging never reaches."""
        log: list = []
        return log[-1] if self._merge(text, log) == [text] else None

    def _stay_apart(self, left: str, right: str) -> bool:
        """Whether merging the characters of both pieces gives these two again; by undoing their last merges in turn."""
        level, part, a, b = self.level, self.part, left, right
        limit = len(level) + 1
        while True:
            r = level.get(a + b)
            if r is not None and r < limit:
                return False
            ra, rb = level.get(a, -1) if part.get(a) else -1, level.get(b, -1) if part.get(b) else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # undo the later merge; an equal one on the right came second
                limit, a = ra, part[a][1]
            else:
                limit, b = rb + 1, part[b][0]

    def _pieces(self, text: str) -> list[str]:
        apart, longest, shorter, reach = self.apart, self.longest, self.shorter, self.automaton.longest_prefix
        n, at, failed, out, ahead = len(text), 0, b"", [], self.ahead
        rest = text[:ahead]
        k = reach(rest)  # characters that begin some piece
        token, last = longest[rest[:k]] if k else rest[0], ""
        while True:
            while token is not None:
                if not (failed and failed[at + len(token)]):
                    ok = apart.get((last, token))
                    if ok is None:
                        ok = self._pair((last, token))
                    if ok:
                        break
                token = shorter.get(token)
            if token is not None:
                out.append(token)
                at += len(token)
                if at == n:
                    return out
                last, rest = token, text[at : at + ahead]
                k = reach(rest)
                token = longest[rest[:k]] if k else rest[0]
            else:
                failed = failed or bytearray(n + 1)
                failed[at] = 1
                token = out.pop()
                at -= len(token)
                last = out[-1] if out else ""
                token = shorter.get(token)

    def _pair(self, pair: tuple[str, str]) -> bool:
        if len(self.apart) > MEMO_LIMIT:
            self.apart.clear()
        left, right = pair
        if SPACE * 2 in left + right:  # runs of white space have one score, and the leftmost of equal merges comes first
            ok = not left or self._merge(left + right) == [left, right]
        else:
            ok = not left or self._stay_apart(left, right)
        self.apart[pair] = ok
        return ok

    def _ids(self, pieces: list[str]) -> list[int]:
        out = []
        for x in pieces:
            i = self.id.get(x)
            out.extend([i] if i is not None else [self.bytes[b] for b in x.encode("utf-8", "surrogatepass")])
        return out

    def parts(self, text: str) -> tuple[list[str], list[str]]:
        """(ids as decimal text, decoded text) of the text's parts, each list in order."""
        ids: list[str] = []
        shown: list[str] = []

        def add(part: str) -> None:
            i, t = self._part(part)
            ids.append(i)
            shown.append(t)

        get = self.memo.get
        for n, line in enumerate(text.split("\n") if text else []):
            if n:
                add("\n")
                if not line:
                    continue
            if SPACE in line:
                line = line.replace(SPACE, " ")
            words = line.split(" ")
            if n:  # only the text's beginning gets a "▁" of its own
                if words[0]:
                    add(words[0])
                words = words[1:]
            if "" in words:  # runs of white space belong to the word after them
                run = ""
                for x in words:
                    run += SPACE
                    if x:
                        add(run + x)
                        run = ""
                if run:
                    add(run)
                continue
            got = list(map(get, words))
            if None in got:
                got = [x or self._word(w) for x, w in zip(got, words)]
            ids += got
            shown += [self.odd.get(w) or " " + w for w in words] if self.odd else [" " + w for w in words]
        return ids, shown

    def _word(self, word: str) -> str:
        """The ids of "▁" + word, remembered by the word; ``odd`` holds what is decoded to anything but the word after a space."""
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > MEMO_LIMIT:  # words of the last full memo come back without work
                self.old = dict(self.memo)
                self.memo.clear()
            got = self.old.pop(word, None)
            if got is None:
                got, text = self._part(SPACE + word)
                if text != " " + word:
                    self.odd[word] = text
            if len(word) < WORD_CHARS:
                self.memo[word] = got
        return got

    def _part(self, text: str) -> tuple[str, str]:
        """(ids, decoded text) of a part."""
        pieces = self._pieces(text)
        try:
            return ",".join([self.decimal[x] for x in pieces]), "".join([self.shown[x] for x in pieces])
        except KeyError:
            ids = self._ids(pieces)
            return ",".join(map(str, ids)), self._text(ids)

    def _text(self, ids) -> str:
        """The pieces' text with white space back; runs of byte pieces become characters, broken ones U+FFFD for each byte."""
        out, run = [], bytearray()

        def flush():
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[:n]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    n = 1
                del run[:n]

        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            flush()
            if i in self.unknown:
                out.append(" ⁇ ")
            elif i not in self.special:
                out.append(self.piece[i].replace(SPACE, " "))
        flush()
        return "".join(out)

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids in self.parts(text)[0] for i in ids.split(",")]

    def decode(self, ids) -> str:
        text = self._text(ids)
        first = next((i for i in ids if i not in self.special), None)
        return text[1:] if first is not None and self.piece[first].startswith(SPACE) else text


def forget() -> None:
    """Empty the memos of the loaded models."""
    for work in _loaded.values():
        for memo in (work.memo, work.old, work.odd, work.apart):
            memo.clear()


keep_for_a_partition(forget)


def codec(path: str) -> PieceCodec:
    if path not in _loaded:
        _loaded[path] = PieceCodec(path)
    return _loaded[path]


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids (decimal, joined by commas), decoded (the text that decoding the ids gives)."""
    return _mapped(docs, model_path, "doc_id long, n_tokens long, ids string, decoded string", lambda ids, text: {"ids": ids, "decoded": text})


def digest_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """encode_pieces with the SHA-256 of ids and decoded text in their place: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
    return _mapped(docs, model_path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, text: {"ids_sha256": sha(ids), "decoded_sha256": sha(text)})


def _mapped(docs: DataFrame, model_path: str, schema: str, columns) -> DataFrame:
    def run(batches):
        import pandas as pd

        work = codec(model_path)
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                some, rows = pdf.iloc[at : at + 256], []
                for text in some["text"]:
                    parts, shown = work.parts(text)
                    ids = ",".join(parts)
                    rows.append({"n_tokens": ids.count(",") + 1 if parts else 0} | columns(ids, "".join(shown)[1:]))
                out = pd.DataFrame(rows)
                out.insert(0, "doc_id", some["doc_id"].to_numpy())
                yield out

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), run, schema)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: digests of the ids and of the decoded text of every document."""
    import public_tokenizers

    return digest_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
