"""PNG and JPEG byte streams built from their public structure."""

import struct
import zlib

PNG_SIGNATURE = bytes.fromhex("89504E470D0A1A0A")
URI = b"http://cv.iptc.org/newscodes/digitalsourcetype/trainedAlgorithmicMedia"


def chunk(kind: bytes, data: bytes = b"") -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(width=1, height=1, pixel=lambda x, y: (0, 0, 0), extra=(), trailing=b"") -> bytes:
    rows = b"".join(b"\0" + b"".join(bytes(pixel(x, y)) for x in range(width))
                    for y in range(height))
    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return (PNG_SIGNATURE + chunk(b"IHDR", header) + b"".join(extra)
            + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND") + trailing)


def text(kind: bytes, keyword: bytes, body: bytes) -> bytes:
    return chunk(kind, keyword + b"\0" + body)


def segment(marker: int, data: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(data) + 2) + data


def jpeg(*segments: bytes, trailing: bytes = b"") -> bytes:
    return b"\xff\xd8" + b"".join(segments) + b"\xff\xda\0\x02\xa5\xc3\x7e\xff\xd9" + trailing
