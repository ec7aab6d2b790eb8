"""Readers of container formats: ZIP entry lists, OOXML text and properties, image headers, RTF fields, media probes."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

MEMBERS = "entry_path string, size_bytes long, compressed_bytes long, error string"


@udtf(returnType=MEMBERS)
class ZipEntries:
    """One row for each entry of a ZIP that is no folder; a broken archive gives one row with the error."""

    def eval(self, content: bytes):
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for e in z.infolist():
                    if not e.is_dir():
                        yield e.filename, e.file_size, e.compress_size, None
        except (zipfile.BadZipFile, OSError, ValueError, TypeError) as e:
            yield None, None, None, str(e)


def zip_entry_count(tail: bytes | None) -> int | None:
    """Number of entries from the end-of-directory record, ZIP64 included, without opening the archive."""
    if not tail:
        return None
    at = tail.rfind(b"PK\x05\x06")
    if at < 0 or at + 22 > len(tail):
        return None
    (n,) = struct.unpack_from("<H", tail, at + 10)
    wide = tail.rfind(b"PK\x06\x06", 0, at)
    if n == 0xFFFF and wide >= 0 and wide + 40 <= len(tail):
        (n,) = struct.unpack_from("<Q", tail, wide + 32)
    return n


def ooxml_text(content: bytes, suffix: str) -> str:
    """Text of a .docx, .pptx or .xlsx, part by part."""
    wanted = {".docx": r"word/document\.xml", ".pptx": r"ppt/slides/slide\d+\.xml", ".xlsx": r"xl/sharedStrings\.xml"}[suffix]
    number = lambda n: [int(x) for x in re.findall(r"\d+", n)]
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted((n for n in z.namelist() if re.fullmatch(wanted, n)), key=number):
            for block in ElementTree.fromstring(z.read(name)).iter():
                kind = block.tag.rpartition("}")[2]
                if kind in ("p", "si"):
                    out.append("".join(t.text or "" for t in block.iter() if t.tag.rpartition("}")[2] == "t"))
    return "\n".join(out)


def ooxml_properties(content: bytes) -> dict[str, str]:
    """title, creator, lastModifiedBy, subject, created, modified of docProps/core.xml."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if "docProps/core.xml" not in z.namelist():
            return {}
        root = ElementTree.fromstring(z.read("docProps/core.xml"))
    return {e.tag.rpartition("}")[2]: e.text for e in root if e.text}


def image_size(head: bytes) -> tuple[str, int, int] | None:
    """(format, width, height) of a PNG, GIF, BMP or JPEG header."""
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) >= 24:
        return "PNG", *struct.unpack(">II", head[16:24])
    if head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 10:
        return "GIF", *struct.unpack("<HH", head[6:10])
    if head[:2] == b"BM" and len(head) >= 26:
        w, h = struct.unpack("<ii", head[18:26])
        return "BMP", w, abs(h)
    if head[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(head) and head[at] == 0xFF:
            mark, size = head[at + 1], struct.unpack(">H", head[at + 2 : at + 4])[0]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", head[at + 5 : at + 9])
                return "JPEG", w, h
            at += 2 + size
    return None


def grey_matrix(image):
    """The grey values of a decoded image as rows."""
    import numpy as np

    return np.asarray(image, float)


def average_hash(grey, side: int = 8) -> str:
    """Hash of a grey matrix by comparing cell means with the overall mean."""
    cells = _cells(grey, side, side)
    return _hex((cells > cells.mean()).ravel())


def difference_hash(grey, side: int = 8) -> str:
    cells = _cells(grey, side, side + 1)
    return _hex((cells[:, 1:] > cells[:, :-1]).ravel())


def perceptual_hash(grey, side: int = 8) -> str:
    """Hash of the low frequencies of a cosine transform against their median."""
    import numpy as np

    n = side * 4
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    low = (basis @ _cells(grey, n, n) @ basis.T)[:side, :side]
    return _hex((low > np.median(low)).ravel())


def _cells(grey, rows: int, cols: int):
    import numpy as np

    g = np.asarray(grey, float)
    r, c = np.arange(rows + 1) * g.shape[0] // rows, np.arange(cols + 1) * g.shape[1] // cols
    return np.array([[g[r[i] : max(r[i + 1], r[i] + 1), c[j] : max(c[j + 1], c[j] + 1)].mean() for j in range(cols)] for i in range(rows)])


def _hex(bits) -> str:
    return f"{int(''.join('1' if b else '0' for b in bits), 2):0{len(bits) // 4}x}"


def rtf_field(text: Column, name: str) -> Column:
    """The value of an RTF info field such as ``title``; null without it."""
    return F.nullif(F.trim(F.regexp_extract(text, r"\{\\" + name + r" ([^{}\\]*)\}", 1)), F.lit(""))


def rtf_info(text: str) -> dict[str, str]:
    """Info fields of an RTF: texts as they stand, dates as ISO seconds."""
    out = {k: m[1].strip() for k in ("title", "author", "subject") if (m := re.search(r"\{\\" + k + r" ([^{}\\]*)\}", text))}
    for k in ("creatim", "revtim"):
        if m := re.search(r"\{\\" + k + r"((?:\\(?:yr|mo|dy|hr|min|sec)\d+)+)\}", text):
            told = {n: int(v) for n, v in re.findall(r"\\(yr|mo|dy|hr|min|sec)(\d+)", m[1])}
            out[k] = f"{told.get('yr', 1):04d}-{told.get('mo', 1):02d}-{told.get('dy', 1):02d}T{told.get('hr', 0):02d}:{told.get('min', 0):02d}:{told.get('sec', 0):02d}"
    return out


#: Byte order marks and their encodings, the longer first (fixed values).
MARKS = ((b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def decode_bytes(content: bytes) -> tuple[str, str]:
    """(text, encoding): by a byte order mark, as UTF-8, by a detector where one is installed, else byte by byte."""
    for mark, name in MARKS:
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace"), name
    try:
        return content.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        pass
    try:
        import charset_normalizer

        best = charset_normalizer.from_bytes(content).best()
        if best is not None:
            return str(best), best.encoding
    except ImportError:
        pass
    return content.decode("latin-1"), "latin-1"


def decode(content: Column) -> Column:
    """Bytes to text: byte order marks (UTF-32 first), then UTF-8, then Latin-1."""
    h = F.hex(F.substring(content, 1, 4))
    after = lambda n: F.substring(content, n + 1, 1 << 30)
    as_ = lambda n, c: F.decode(after(n), c)
    utf8 = F.try_validate_utf8(content.cast("string"))
    return (
        F.when(h == "FFFE0000", as_(4, "UTF-32LE")).when(h == "0000FEFF", as_(4, "UTF-32BE")).when(h.startswith("EFBBBF"), after(3).cast("string"))
        .when(h.startswith("FFFE"), as_(2, "UTF-16LE")).when(h.startswith("FEFF"), as_(2, "UTF-16BE")).when(utf8.isNotNull(), utf8).otherwise(F.decode(content, "ISO-8859-1"))
    )


PROBE = "format struct<duration:string,bit_rate:string,tags:map<string,string>>, streams array<struct<codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string>>"


def frame_rate(fraction: Column) -> Column:
    """``30000/1001`` as ``29.97``; null for a zero denominator or something else."""
    parts = F.split(fraction, "/")
    n, d = F.get(parts, F.lit(0)).try_cast("double"), F.coalesce(F.get(parts, F.lit(1)), F.lit("1")).try_cast("double")
    return F.when(d != 0, F.format_string("%.2f", n / d))


def probe_fields(json: Column) -> dict[str, Column]:
    """Columns of a media probe's JSON."""
    p = F.from_json(json, PROBE)
    video = F.get(F.filter(p["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    audio = F.get(F.filter(p["streams"], lambda s: s["codec_type"] == "audio"), F.lit(0))
    return {
        "duration_seconds": p["format"]["duration"].try_cast("double"), "bitrate": p["format"]["bit_rate"].try_cast("long"), "title": p["format"]["tags"]["title"],
        "artist": p["format"]["tags"]["artist"], "album": p["format"]["tags"]["album"], "audio_codec": audio["codec_name"], "video_codec": video["codec_name"],
        "width_px": video["width"], "height_px": video["height"], "frame_rate": frame_rate(video["avg_frame_rate"]),
    }
