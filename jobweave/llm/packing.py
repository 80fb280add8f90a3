"""Best-fit packing of token sequences, improved by swaps between underfull bins."""

from __future__ import annotations

import os
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.store import id_of, keyed, returning_memory, stored

CAPACITY = 4096
END_ID = 1
#: Words that a task remembers, some 200 bytes each; words tokenized at a time.
REMEMBERED, AT_ONCE = 700_000, 100
#: Pieces packed together, about.
GROUP = 25_000


class Words(dict):
    """Ids of words between blanks, as bytes. A word that is new is taken apart where the tokenizer does so for sure.

    The tokenizer composes (NFC), lowers case and drops white space; what is then
    all letters never joins with the marks of punctuation before or after it (but
    for the apostrophe), so such letters are tokenized by themselves, as a word of
    their own that is remembered too. Letters that come out with a combining mark, as the Turkish
    dotted capital does, join with what follows: their words are tokenized whole.
    """

    MARKS = b".,;:!?*#$%&|\"()[]-"

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [found.ids for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, letters: list[bytes]) -> None:
        """Learns words of letters, many at once: each ends with the one token that closes it."""
        for lo in range(0, len(letters), AT_ONCE):
            part = letters[lo : lo + AT_ONCE]
            ids = array("I", self.ids([b" ".join(part).decode()])[0])
            ends = (4 * (np.flatnonzero(self.closing[np.frombuffer(ids, np.uint32)]) + 1)).tolist()
            raw = ids.tobytes()
            if len(ends) == len(part):
                self.update(zip(part, [raw[s:e] for s, e in zip([0, *ends], ends)], strict=True))
            else:
                self.encode_whole(part)

    def encode_whole(self, texts: list[bytes]) -> None:
        for lo in range(0, len(texts), 10_000):
            part = texts[lo : lo + 10_000]
            self.update((t, array("I", ids).tobytes()) for t, ids in zip(part, self.ids([t.decode() for t in part]), strict=True))

    def learn(self, words: set[bytes]) -> None:
        new = words - self.keys()
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = words
        marks, strip = self.MARKS, bytes.strip
        simple = [w for w in new if w.isalpha()]  # ASCII letters
        apart, whole = [], []
        for word in new.difference(simple):
            core = low = strip(word, marks)
            if not core.isalpha():
                letters = core.decode()
                if max(letters, default="") < "\u0100":
                    # here a letter's lower case never depends on others, so all spellings are one
                    low, of_letters = letters.lower().encode(), letters.isalpha()
                else:
                    of_letters = normalize("NFC", letters).lower().isalpha()
                if not of_letters:
                    whole.append(word)
                    continue
            apart.append((word, core, low))
        self.encode(simple)
        self.encode(list({low for _, _, low in apart} - self.keys()))
        self.encode_whole(whole)
        beside = {m for word, core, _ in apart if word != core for m in word.split(core, 1)}
        self.encode_whole(list(beside - self.keys()))
        for word, core, low in apart:
            if word == core:
                self[word] = self[low]
            else:
                before, after = word.split(core, 1)
                self[word] = self[before] + self[low] + self[after]


def words_in(text: bytes) -> list[bytes]:
    """Words between blanks, A-Z in lower case, so that few different ones are left.

    The tokenizer lowers case too; only where a combining mark (U+0300 on) stands
    might it join a capital or a small letter alone, so such texts stay as they are.
    """
    return (text if b"\xcc" in text or b"\xcd" in text else text.lower()).split()


@returning_memory
def pieces_of(batches: Iterator[pa.RecordBatch], path: str, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Token pieces of each document; a word that recurs is tokenized once for a while."""
    known = Words(path)
    last = array("I", [END_ID]).tobytes()
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    for batch in batches:
        texts = [words_in(t.as_buffer().to_pybytes()) if t.is_valid else [] for t in batch.column("text")]
        known.learn(set().union(*texts))
        rows: list[tuple] = []
        for key, mark, words in zip(batch.column("key").to_pylist(), batch.column("mark").to_pylist(), texts, strict=True):
            ids = b"".join(map(known.__getitem__, words)) + last
            for number, start in enumerate(range(0, len(ids), 4 * capacity)):
                piece = ids[start : start + 4 * capacity]
                rows.append((key, mark, number, start // 4, len(piece) // 4, zlib.crc32(piece), piece if with_ids else None))
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
            names=["key", "mark", "piece", "start", "length", "ids_crc32", "ids"],
        )


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest first, each into the fullest bin that still takes it."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    mask, bins = 0, []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                mask ^= 1 << free
            bins[b].append(item)
        else:
            free, b = capacity, len(bins)
            bins.append([item])
        free -= size
        if free:
            if not room[free]:
                mask |= 1 << free
            room[free].append(b)
    return bins


def below(mask: int, size: int) -> int:
    """The largest number up to ``size`` in a set kept as bits; 0 if there is none."""
    return max(0, (mask & ((1 << (size + 1)) - 1)).bit_length() - 1) if size > 0 else 0


class Underfull:
    """Bins with space left, and which of them hold pieces of a size, or two pieces of a size in all."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.bins, self.sizes, self.capacity = bins, sizes, capacity
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        self.order = sorted((b for b in range(len(bins)) if 0 < self.fill[b] < capacity), key=lambda b: (-self.fill[b], b))
        self.holders: list[dict[int, int]] = [{} for _ in range(capacity + 1)]
        self.mask = 0
        self.open = set(self.order)
        for b in self.order:  # the emptiest last: they give first
            for i in bins[b]:
                self.note(b, sizes[i], 1)
        self.pairs: dict[int, list[int]] | None = None
        self.known_sums: dict[int, int] = {}

    def note(self, b: int, size: int, change: int) -> None:
        holders = self.holders[size]
        count = holders.get(b, 0) + change
        if count:
            holders[b] = count
            self.mask |= 1 << size
        else:
            del holders[b]
            if not holders:
                self.mask &= ~(1 << size)

    def take_out(self, b: int) -> None:
        self.open.discard(b)
        for i in self.bins[b]:
            self.note(b, self.sizes[i], -1)

    def pair_sums(self, b: int) -> int:
        """All sums of two pieces of a bin, as bits; kept until the bin changes. Its sizes are few, even if its pieces are many."""
        if b not in self.known_sums:
            seen = sums = 0
            for size, count in Counter(self.sizes[i] for i in self.bins[b]).items():
                sums |= seen << size | (count > 1) << 2 * size
                seen |= 1 << size
            self.known_sums[b] = sums
        return self.known_sums[b]

    def pair_holder(self, low: int, high: int) -> tuple[int, int] | None:
        """The largest sum over ``low`` and up to ``high`` of two pieces of one bin, and a bin that has it."""
        if self.pairs is None:
            self.pairs, self.pair_mask = {}, 0
            for b in self.order:
                sums = self.pair_sums(b) & ((1 << (self.capacity + 1)) - 1) if b in self.open else 0
                self.pair_mask |= sums
                while sums:
                    top = sums.bit_length() - 1
                    self.pairs.setdefault(top, []).append(b)
                    sums ^= 1 << top
        while (total := below(self.pair_mask, high)) > low:
            holders = self.pairs[total]
            while holders:
                b = holders[-1]
                if b in self.open and self.pair_sums(b) >> total & 1:
                    return total, b
                holders.pop()  # it has given a piece away since
            self.pair_mask ^= 1 << total
        return None

    def best_exchange(self, target: int) -> tuple[list[int], list[int], int] | None:
        """What ``target`` gives, the sizes it gets for that, and from which bin; most gain first, fewest pieces on a tie.

        The others are no fuller than the target, so squared fill grows with any
        gain: by a move, one for one, two of one bin for one, or one for two.
        """
        sizes, free = self.sizes, self.capacity - self.fill[target]
        own = list({sizes[i]: i for i in self.bins[target]}.items())
        gain, best = 0, None
        for given, i in [(0, None), *own]:
            size = below(self.mask, given + free)
            if size - given > gain:
                gain, best = size - given, ([] if i is None else [i], [size], next(reversed(self.holders[size])))
                if gain == free:
                    return best
        for given, i in own:
            if found := self.pair_holder(given + gain, given + free):
                total, holder = found
                gain, best = total - given, ([i], self.split(holder, total), holder)
                if gain == free:
                    return best
        sums = self.pair_sums(target)
        for more in range(min(free, self.mask.bit_length() - 1), gain, -1):
            if wanted := sums << more & self.mask:
                size = (wanted & -wanted).bit_length() - 1
                return self.last_pair(target, size - more), [size], next(reversed(self.holders[size]))
        return best

    def last_pair(self, b: int, total: int) -> list[int]:
        """Of a bin's pairs of that sum the one whose later piece comes last; its other piece is the last such before that."""
        last: dict[int, int] = {}
        pair: list[int] = []
        for i in self.bins[b]:
            if (other := last.get(total - self.sizes[i])) is not None:
                pair = [i, other]
            last[self.sizes[i]] = i
        return pair

    def split(self, b: int, total: int) -> list[int]:
        held = self.holders
        for i in self.bins[b]:
            size, rest = self.sizes[i], total - self.sizes[i]
            if rest > 0 and held[rest].get(b, 0) > (rest == size):
                return [size, rest]
        raise ValueError("no such pair")

    def fill_up(self, target: int) -> None:
        self.take_out(target)
        while self.fill[target] < self.capacity and (found := self.best_exchange(target)):
            give, wanted, source = found
            got = []
            for size in wanted:
                at = next(n for n, i in enumerate(self.bins[source]) if self.sizes[i] == size)
                got.append(self.bins[source].pop(at))
                self.note(source, size, -1)
            for i in give:
                self.bins[target].remove(i)
                self.bins[source].append(i)
                self.note(source, self.sizes[i], 1)
            self.bins[target] += got
            self.known_sums.pop(source, None)
            self.known_sums.pop(target, None)
            change = sum(wanted) - sum(self.sizes[i] for i in give)
            self.fill[source] -= change
            self.fill[target] += change


def empty_bins(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search: bins, the fullest first, draw from emptier ones by the best exchanges until these are empty.

    Every underfull bin takes its turn in a pass; passes go on until one empties
    nothing, or until as few bins are left as all pieces need.
    """
    bins = [b for b in bins if b]
    fewest = -(-sum(sizes[i] for b in bins for i in b) // capacity)
    while len(bins) > fewest:
        underfull = Underfull(bins, sizes, capacity)
        for target in underfull.order:
            if bins[target]:
                underfull.fill_up(target)
        left = [b for b in bins if b]
        if len(left) == len(bins):
            break
        bins = left
    return bins


def pack_group(table: pa.Table, capacity: int, level: int) -> pa.Table:
    """A group's pieces in bins: packed anew on the first level, then the bins that they are in already, improved."""
    table = table.sort_by([(c, "ascending") for c in ("bin", "length", "key", "mark", "piece")])
    sizes, before = table.column("length").to_pylist(), table.column("bin").to_pylist()
    group = table.column("group")[0].as_py()
    if level:
        held: dict[int, list[int]] = {}
        for i, b in enumerate(before):
            held.setdefault(b, []).append(i)
        bins = empty_bins(list(held.values()), sizes, capacity)
    else:
        bins = empty_bins(best_fit(sizes, capacity), sizes, capacity)
    place, fill, offset = [0] * len(sizes), [0] * len(sizes), [0] * len(sizes)
    for number, members in enumerate(bins):
        at = 0
        for i in members:
            place[i] = level << 56 | group << 26 | number
            offset[i] = at
            at += sizes[i]
        for i in members:
            fill[i] = at
    for name, values in (("bin", place), ("fill", fill), ("offset", offset)):
        table = table.set_column(table.schema.get_field_index(name), name, pa.array(values, pa.int64()))
    return table


def packer(capacity: int, level: int) -> Callable[[pa.Table], pa.Table]:
    return lambda table: pack_group(table, capacity, level)


def by_fill(packed: DataFrame) -> tuple[DataFrame, int]:
    """Pieces with the group that their bin is in on the next level: bins of neighbouring fills, GROUP pieces or so.

    The driver gets the number of pieces for each fill, at most one a token. A
    fill with more pieces than a group is dealt over several by its bins' numbers.
    """
    counts = packed.groupBy("fill").agg(F.count("*").alias("n")).orderBy("fill").collect()
    rows, first, held = [], 0, 0
    for fill, n in counts:
        parts = -(-n // GROUP)
        if parts > 1 or held + n > GROUP:
            first, held = first + bool(held), 0
        rows.append((fill, first, parts))
        if parts > 1:
            first += parts
        else:
            held += n
    if not rows:
        return packed, 0
    deal = packed.sparkSession.createDataFrame(rows, "fill long, first long, parts long")
    dealt = packed.drop("group").join(F.broadcast(deal), "fill")
    group = F.col("first") + F.pmod(F.xxhash64("bin"), F.col("parts"))
    return dealt.withColumn("group", group).select(packed.columns), first + bool(held)


def tokens_of(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """key, mark, piece, start, length, ids_crc32 and ids (null unless asked for) of the pieces of each document."""
    schema = "key long, mark long, piece int, start long, length long, ids_crc32 long, ids binary"
    return keyed(documents).mapInArrow(lambda b: pieces_of(b, tokenizer_path, capacity, with_ids), schema)


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset: every piece's place in a sequence.

    A document's ids end with END_ID; a longer one than ``capacity`` is cut into
    pieces of that length. Pieces are packed in groups of about GROUP, dealt by a
    hash, longest first into the fullest bin that takes them; then local search
    empties bins, see ``empty_bins``. All underfull bins meet again, the emptiest
    with the emptiest, level by level until a level empties none. So the number
    of sequences exceeds the fewest by what the last level's groups can't save,
    whatever the number of groups.

    Null and empty texts have the one id. A null doc_id and repeated rows are
    packed like others. Other columns are not read.
    """
    tokens = stored(tokens_of(documents, tokenizer_path, capacity).drop("ids"), "pieces")
    groups = max(1, -(-tokens.where(F.col("length") < capacity).count() // GROUP))
    # a full piece is a sequence of its own, with a negative number by its place in the stored table
    whole = tokens.where(F.col("length") == capacity).select(
        "*", (-F.monotonically_increasing_id() - 1).alias("bin"), F.lit(0).cast("long").alias("offset")
    )
    nothing = {c: F.lit(0).cast("long") for c in ("bin", "fill", "offset")}
    left = tokens.where(F.col("length") < capacity).withColumns(
        {"group": F.pmod(F.xxhash64("key", "mark", "piece"), F.lit(groups)), **nothing}
    )
    schema, done, level, before = left.schema, [], 0, None
    while True:
        packed = stored(left.groupBy("group").applyInArrow(packer(capacity, level), schema), "packed")
        underfull = packed.where(F.col("fill") < capacity)
        bins = underfull.where("offset = 0").count()
        total = packed.where("offset = 0").count()
        done.append(packed.where(F.col("fill") == capacity))
        if groups <= 1 or not bins or (before is not None and total >= before):
            done.append(underfull)
            break
        before, level = bins, level + 1
        left, groups = by_fill(underfull)
    out = whole.select("key", "piece", "start", "length", "ids_crc32", "bin", "offset")
    for d in done:
        out = out.unionByName(d.select(out.columns))
    return out.select(
        id_of(F.col("key")).alias("doc_id"), "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset"
    )
