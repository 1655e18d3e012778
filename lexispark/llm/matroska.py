"""Matroska media columns: payloads written as audio tracks, and files parsed into packet tables.

`store` writes each text's bytes (padded to a positive multiple of 64) as 8-bit PCM samples of one track: EBML header,
segment information, track entry, clusters of laced blocks, cues. `packets` parses any Matroska file into one row per frame:
track, timestamp, byte range, key frame flag, lacing, cluster, and whether a cue points at the cluster. It reads elements of
variable length, unknown sizes (segments and clusters), SimpleBlocks and BlockGroups, and all four lacings (none, Xiph, fixed,
EBML). Both run per row; nothing is gathered across rows.

Nulls and empty texts are 64 zero bytes. A null or damaged file gives the packets before the damage and an `error` text (so do
timestamps beyond a bigint and a time scale of 0); elements may be nested to any depth. Equal texts give equal files, repeated
rows equal results. doc_id may be of any type, null too; other columns are not kept. Empty tables give empty results."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAD, RATE, FRAME, LACED, CLUSTER = 64, 8000, 1024, 8, 32
#: Element ids, fixed by the format.
EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER_ID, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
TIMESTAMP, SIMPLE, GROUP, BLOCK, REFERENCE, SCALE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB, 0x2AD7B1
CUE, CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, TRACK, CLUSTER_ID, CUES, GROUP, CUE, CUE_PLACES}
TOP = {INFO, TRACKS, CLUSTER_ID, CUES, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}


def _vint(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(code: int, *content: bytes) -> bytes:
    body = b"".join(content)
    return code.to_bytes((code.bit_length() + 7) // 8, "big") + _vint(len(body)) + body


def _number(code: int, n: int) -> bytes:
    return _element(code, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes]) -> tuple[int, bytes]:
    """Lacing flags and the block's data: none for one frame, fixed for equal sizes, EBML for others."""
    if len(frames) == 1:
        return 0, frames[0]
    sizes = [len(x) for x in frames]
    head = bytes([len(frames) - 1])
    if len(set(sizes)) == 1:
        return 0b10, head + b"".join(frames)
    lace = _vint(sizes[0])
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        width = next(w for w in range(1, 9) if abs(b - a) <= (1 << 7 * w - 1) - 1)
        lace += _vint(b - a + (1 << 7 * width - 1) - 1, width)
    return 0b11, head + lace + b"".join(frames)


def write_file(payload: bytes) -> bytes:
    """A Matroska file with the payload as one track of 8-bit mono PCM, timestamps in samples."""
    head = _element(EBML, _number(0x4286, 1), _number(0x42F7, 1), _number(0x42F2, 4), _number(0x42F3, 8), _element(0x4282, b"matroska"), _number(0x4287, 4), _number(0x4285, 2))
    info = _element(INFO, _number(SCALE, 10**9 // RATE), _element(0x4D80, b"lexispark"), _element(0x5741, b"lexispark"), _element(0x4489, struct.pack(">d", float(len(payload)))))
    audio = _element(0xE1, _element(0xB5, struct.pack(">d", float(RATE))), _number(0x9F, 1), _number(0x6264, 8))
    tracks = _element(TRACKS, _element(TRACK, _number(0xD7, 1), _number(0x73C5, 1), _number(0x83, 2), _element(0x86, b"A_PCM/INT/LIT"), audio))
    body, cues, at = [info, tracks], [], len(info) + len(tracks)
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    for first in range(0, len(frames), CLUSTER):
        start = first * FRAME
        blocks = [_number(TIMESTAMP, start)]
        for i in range(first, min(first + CLUSTER, len(frames)), LACED):
            part = frames[i : min(i + LACED, first + CLUSTER)]
            flags, data = _laced(part)
            # a block's time counts from its cluster's in 16 bits with sign: 31 * 1024 samples at most here
            blocks.append(_element(SIMPLE, _vint(1), struct.pack(">hB", (i - first) * FRAME, 0x80 | flags << 1), data))
        cluster = _element(CLUSTER_ID, *blocks)
        cues.append(_element(CUE, _number(CUE_TIME, start), _element(CUE_PLACES, _number(CUE_TRACK, 1), _number(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return head + _element(SEGMENT, *body, _element(CUES, *cues))


class Damaged(ValueError):
    """The file ends early or an element makes no sense."""


def _read_vint(data: memoryview, at: int, end: int, keep: bool = False) -> tuple[int, int, bool]:
    """Value, next place, and whether all value bits are set (unknown size). keep: the marker stays (ids)."""
    if at >= end or not data[at]:
        raise Damaged(f"no variable-length number at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Damaged(f"the file ends in a number at {at}")
    n = int.from_bytes(data[at : at + width], "big")
    bare = n ^ 1 << 7 * width
    return (n if keep else bare), at + width, bare == (1 << 7 * width) - 1


def _frame_sizes(data: memoryview, at: int, end: int, lacing: int) -> tuple[int, list[int]]:
    if not lacing:
        return at, [end - at]
    if at >= end:
        raise Damaged(f"a laced block without frames at {at}")
    count, at = data[at] + 1, at + 1
    if lacing == 2:
        if (end - at) % count:
            raise Damaged(f"unequal frames under fixed lacing at {at}")
        return at, [(end - at) // count] * count
    sizes: list[int] = []
    while len(sizes) < count - 1:
        if lacing == 1:
            size = 0
            while True:
                if at >= end:
                    raise Damaged(f"the block ends in its lacing at {at}")
                size, at = size + data[at], at + 1
                if data[at - 1] < 255:
                    break
        else:
            value, after, _ = _read_vint(data, at, end)
            size = value if not sizes else sizes[-1] + value - ((1 << 7 * (after - at) - 1) - 1)
            at = after
        sizes.append(size)
    rest = end - at - sum(sizes)
    if rest < 0 or min(sizes, default=0) < 0:
        raise Damaged(f"frames larger than their block at {at}")
    return at, [*sizes, rest]


def read_file(content: bytes | None) -> tuple[list[dict], str | None]:
    """The file's packets in order, and what is wrong with it, if anything."""
    packets: list[dict] = []
    if content is None:
        return packets, "no file"
    data, scale, cues, places = memoryview(content), 1_000_000, set(), {}
    state = {"cluster": -1, "time": 0, "segment": 0, "n": -1}

    def block(at: int, end: int, key: bool | None) -> None:
        track, at, _ = _read_vint(data, at, end)
        if at + 3 > end:
            raise Damaged(f"a short block at {at}")
        offset, flags = struct.unpack(">hB", data[at : at + 3])
        lacing = flags >> 1 & 3
        at, sizes = _frame_sizes(data, at + 3, end, lacing)
        for n, size in enumerate(sizes):
            packets.append({"track": track, "time": state["time"] + offset, "offset": at, "size": size, "key_frame": bool(flags & 0x80) if key is None else key, "lacing": lacing, "lace": n, "cluster": state["n"]})
            at += size

    error = None
    try:
        code, at, _ = _read_vint(data, 0, len(data), keep=True)
        if code != EBML:
            raise Damaged("no EBML header")
        at, end, parent, first, outer = 0, len(data), 0, 0, []  # outer: (end, parent, first packet, size known) around the element
        while True:
            if at >= end:
                if not outer:
                    break
                end, parent, first, _ = outer.pop()
                continue
            begin = at
            code, at, _ = _read_vint(data, at, end, keep=True)
            if code in TOP and outer and not outer[-1][3]:
                # a cluster (and what is open in it) of unknown size ends at the next element of the segment
                while parent not in (SEGMENT, 0) and outer and not outer[-1][3]:
                    end, parent, first, _ = outer.pop()
            size, at, unknown = _read_vint(data, at, end)
            stop = end if unknown else at + size
            if stop > end:
                if code not in MASTERS:
                    raise Damaged(f"the file ends in an element at {begin}")
                stop, unknown = end, True
            if code == SEGMENT:
                state["segment"] = at
            elif code == CLUSTER_ID:
                state["n"] += 1
                state["time"] = 0
                places[state["n"]] = begin - state["segment"]
            if code in MASTERS:
                outer.append((end, parent, first, not unknown))
                end, parent, first = stop, code, len(packets)
                continue
            value = int.from_bytes(data[at:stop], "big") if size <= 8 else 0
            if code == TIMESTAMP:
                state["time"] = value
            elif code == SCALE:
                scale = value
            elif code == CUE_CLUSTER:
                cues.add(value)
            elif code == SIMPLE:
                block(at, stop, None)
            elif code == BLOCK and parent == GROUP:
                block(at, stop, True)
            elif code == REFERENCE and parent == GROUP:  # it needs another block, so it is no key frame
                for p in packets[first:]:
                    p["key_frame"] = False
            at = stop
    except Damaged as e:
        error = str(e)
    if not scale:
        error, scale = error or "the time scale is 0", 1_000_000
    for n, p in enumerate(packets):
        p["timestamp_ns"] = p.pop("time") * scale
        p["cued"] = places.get(p["cluster"], -1) in cues
        if not (-(2**63) <= p["timestamp_ns"] < 2**63 and p["track"] < 2**63):
            return packets[:n], f"packet {n} has a time or track out of range"
    return packets, error


def padded(text: str | None) -> tuple[int, bytes]:
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
    return len(data), data + bytes(-len(data) % PAD or (0 if data else PAD))


PACKETS = "track bigint, timestamp_ns bigint, offset bigint, size bigint, key_frame boolean, lacing int, lace int, cluster int, cued boolean"


def _store(texts: pd.Series) -> pd.DataFrame:
    both = [padded(t) for t in texts]
    return pd.DataFrame({"n_bytes": [n for n, _ in both], "media": [write_file(p) for _, p in both]})


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of docs(doc_id, text)."""
    made = F.pandas_udf(_store, "n_bytes long, media binary")("text")
    return docs.select("doc_id", made.alias("made")).select("doc_id", "made.*")


def _read(files: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_file(x) for x in files], columns=["packets", "error"])


def packets(media: DataFrame) -> DataFrame:
    """(doc_id, packet number, packet columns, error): one row per frame; a file without frames has one row without packet."""
    read = F.pandas_udf(_read, f"packets array<struct<{PACKETS.replace(', ', ',').replace(' ', ':')}>>, error string")("media")
    return media.select("doc_id", read.alias("read")).select("doc_id", F.posexplode_outer("read.packets").alias("packet", "p"), "read.error").select("doc_id", "packet", "p.*", "error")


def _digest(files: pd.Series) -> pd.DataFrame:
    rows = []
    for media in files:
        found, error = read_file(media)
        payload = b"".join(media[p["offset"] : p["offset"] + p["size"]] for p in found)
        s = np.frombuffer(payload, np.uint8).astype(np.int64)
        crossings = int(((s[1:] >= 128) != (s[:-1] >= 128)).sum())
        feature = f"A_PCM/INT/LIT;rate={RATE};packets={len(found)};clusters={len({p['cluster'] for p in found})};cued={sum(p['cued'] for p in found)};last_ns={found[-1]['timestamp_ns'] if found else -1};sum={int(s.sum())};energy={int(((s - 128) ** 2).sum())};crossings={crossings};peak={int(s.max(initial=0))}" + (f";error={error}" if error else "")
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media or b""), hashlib.sha256(media or b"").hexdigest(), feature))
    return pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def digests(media: DataFrame) -> DataFrame:
    """What the stored bytes hold: payload and file digests, and a feature text of track, packets and samples."""
    made = F.pandas_udf(_digest, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")("media")
    return media.select("doc_id", "n_bytes", made.alias("made")).select("doc_id", "n_bytes", "made.*")
