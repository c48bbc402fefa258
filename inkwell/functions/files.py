"""File kinds, admission rules, names and sizes as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DOCX_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"


@dataclass(frozen=True)
class Formats:
    """What one service accepts: extensions without dot, MIME types."""

    image_exts: tuple[str, ...]
    image_types: tuple[str, ...] = ()
    pdf_exts: tuple[str, ...] = ("pdf",)
    pdf_types: tuple[str, ...] = ()
    docx_exts: tuple[str, ...] = ()
    docx_types: tuple[str, ...] = ()

    @property
    def exts(self) -> list[str]:
        return sorted({*self.image_exts, *self.pdf_exts, *self.docx_exts})

    @property
    def types(self) -> list[str]:
        return sorted({*self.image_types, *self.pdf_types, *self.docx_types})


# The formats that each service takes. They differ on purpose.
PROFILES = {
    "ui": Formats(
        image_exts=("jpg", "jpeg", "png", "bmp", "gif"),
        image_types=("image/jpeg", "image/jpg", "image/png", "image/bmp", "image/gif"),
        pdf_types=("application/pdf",),
        docx_exts=("docx",),
        docx_types=(DOCX_TYPE,),
    ),
    "ocr": Formats(image_exts=("jpg", "jpeg", "png", "bmp", "tiff", "webp")),
    "convert": Formats(
        image_exts=("jpg", "jpeg", "png", "bmp", "gif", "webp"),
        image_types=("image/jpeg", "image/jpg", "image/png", "image/bmp", "image/gif", "image/x-png", "image/pjpeg", "image/x-jpg", "image/webp"),
        pdf_types=("application/pdf",),
    ),
}
MB = 1024 * 1024
OCR_PIXELS_DPI, PREVIEW_DPI, POINTS_PER_INCH = 300, 150, 72


def text(value) -> Column:
    """Strings name columns; a null counts as an empty text."""
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))


def _last(name: Column) -> Column:
    return F.regexp_replace(name, "(?s)^.*/", "")


def suffix(name) -> Column:
    """The extension with its dot, lower-case; empty for names that only begin with a dot or end in one."""
    return F.lower(F.regexp_extract(_last(text(name)), r"(?s)^\.*[^.].*?(\.[^.]+)$", 1))


def stem(name) -> Column:
    """The last part of a path without its suffix."""
    last = _last(text(name))
    return F.substring(last, F.lit(1), F.length(last) - F.length(suffix(name)))


def _kind(mime, ext, types: tuple[str, ...], exts: tuple[str, ...]) -> Column:
    return text(mime).isin(*types) | F.lower(text(ext)).isin(*("." + e for e in exts))


def is_image(mime="mime", ext="ext", profile: str = "ui") -> Column:
    return _kind(mime, ext, PROFILES[profile].image_types, PROFILES[profile].image_exts)


def is_pdf(mime="mime", ext="ext", profile: str = "ui") -> Column:
    return _kind(mime, ext, PROFILES[profile].pdf_types, PROFILES[profile].pdf_exts)


def is_docx(mime="mime", ext="ext", profile: str = "ui") -> Column:
    return _kind(mime, ext, PROFILES[profile].docx_types, PROFILES[profile].docx_exts)


def is_supported(mime="mime", ext="ext", profile: str = "ui") -> Column:
    return is_image(mime, ext, profile) | is_pdf(mime, ext, profile) | is_docx(mime, ext, profile)


def is_image_like(mime="mime", ext="ext", profile: str = "ui") -> Column:
    """Images, and PDFs as they may hold scans."""
    return is_image(mime, ext, profile) | is_pdf(mime, ext, profile)


def source_kind(mime="mime", ext="ext") -> Column:
    """How a file's pages become images: ``pdf`` or ``image``; null for files that have none."""
    return F.when(is_pdf(mime, ext), "pdf").when(is_image(mime, ext), "image")


def last_dot_part(name="name") -> Column:
    """What stands after the last dot, lower-case; a name without a dot is its own extension."""
    return F.lower(F.element_at(F.split(text(name), "[.]"), -1))


def ocr_kind(name="name") -> Column:
    """``pdf``, ``image`` or null, by the name alone."""
    ext, own = last_dot_part(name), PROFILES["ocr"]
    return F.when(ext.isin(*own.pdf_exts), "pdf").when(ext.isin(*own.image_exts), "image")


def convert_kind(mime="mime", name="name") -> Column:
    """``pdf``, ``image`` or null, by MIME type or extension; a name without a dot has none.

    A file that either sign calls a PDF is read as one.
    """
    ext = F.when(text(name).contains("."), last_dot_part(name)).otherwise("")
    own = PROFILES["convert"]
    pdf = text(mime).isin(*own.pdf_types) | ext.isin(*own.pdf_exts)
    image = text(mime).isin(*own.image_types) | ext.isin(*own.image_exts)
    return F.when(pdf, "pdf").when(image, "image")


def ocr_client_admits(name="name") -> Column:
    """The clients look at the end of the name."""
    return F.lower(text(name)).rlike(rf"\.(?:{'|'.join(PROFILES['ocr'].exts)})$")


def upload_refusal(size="size", mime="mime", ext="ext", most: int = 10 * MB) -> Column:
    """Why the upload gate refuses a file: ``too_large``, then ``unsupported``; null if it doesn't."""
    size = F.col(size) if isinstance(size, str) else size
    return F.when(size > most, "too_large").when(~is_supported(mime, ext), "unsupported")


def full_refusal(present, size="size", mime="mime", ext="ext", length="length", most: int = 50 * MB) -> Column:
    """Why the full check refuses a file: ``missing``, ``too_large``, ``unsupported`` or ``empty``, in this order."""
    size, length = (F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(0)) for x in (size, length))
    return F.when(~present, "missing").when(size > most, "too_large").when(~is_supported(mime, ext), "unsupported").when(length == 0, "empty")


def size_mb(size) -> Column:
    return F.bround(size / MB, 2)


def human_size(size) -> Column:
    """Bytes as text; ties of the single decimal go to the even digit."""
    return F.when(size < 1024, F.format_string("%d B", size)).when(size < MB, F.format_string("%.1f KB", F.bround(size / 1024, 1))).otherwise(F.format_string("%.1f MB", F.bround(size / MB, 1)))


def metadata(name="name", size="size", mime="mime") -> Column:
    """A struct of what is known of a file without reading it."""
    n, s = text(name), F.col(size) if isinstance(size, str) else size
    ext = suffix(name)
    return F.struct(
        n.alias("name"),
        stem(name).alias("stem"),
        ext.alias("ext"),
        s.alias("size_bytes"),
        size_mb(s).alias("size_mb"),
        (F.col(mime) if isinstance(mime, str) else mime).alias("mime_type"),
        is_image(mime, ext).alias("is_image"),
        is_pdf(mime, ext).alias("is_pdf"),
        is_docx(mime, ext).alias("is_docx"),
    )


#: A sign per kind of file.
ICONS = {"image": "🖼️", "pdf": "📄", "docx": "📝", "text": "📋", "other": "📁"}


def icon_kind(mime="mime", ext="ext") -> Column:
    plain = F.lower(text(ext)).isin(".txt", ".csv", ".json")
    return F.when(is_image(mime, ext), "image").when(is_pdf(mime, ext), "pdf").when(is_docx(mime, ext), "docx").when(plain, "text").otherwise("other")


def icon(mime="mime", ext="ext") -> Column:
    kind = icon_kind(mime, ext)
    sign = F.lit(ICONS["other"])
    for name, value in ICONS.items():
        sign = F.when(kind == name, value).otherwise(sign)
    return sign


def preview(mime="mime", ext="ext") -> Column:
    """A struct that says how a file is previewed."""
    m, e = text(mime), text(ext)
    pdf = (m == "application/pdf") | (e == ".pdf")
    image = m.startswith("image/") | e.isin(*("." + x for x in PROFILES["ui"].image_exts))
    docx = (m == DOCX_TYPE) | (e == ".docx")
    return F.struct(
        F.lit(True).alias("show_metadata"),
        F.lit(True).alias("use_column_width"),
        F.when(pdf, PREVIEW_DPI).alias("dpi"),
        F.when(~pdf & image, "Изображение").alias("caption"),
        F.when(~pdf & ~image & docx, 30).alias("paragraphs_per_page"),
        F.when(pdf | (~image & docx), True).alias("show_page_selector"),
    )


def download_name(name, ext: str) -> Column:
    """``ocr_`` and the part before the first dot, of which only letters, digits, ``_`` and ``-`` of any script stay."""
    first = F.element_at(F.split(text(name), "[.]"), 1)
    return F.concat(F.lit("ocr_"), F.regexp_replace(first, r"(?U)[^\w\-_.]", "_"), F.lit(f".{ext}"))


def safe_name(value, most: int = 20) -> Column:
    """Letters and digits of any script, the others as ``_``; the first ``most`` characters."""
    return F.substring(F.regexp_replace(text(value), r"[^\p{L}\p{N}]", "_"), 1, most)


def aligned_name(name, angle) -> Column:
    return F.format_string("aligned_%s_%.1fdeg.png", stem(name), angle)


def binary_name(name, page, threshold) -> Column:
    """``page`` counts from 0."""
    return F.concat(F.lit("binary_"), text(name), F.lit("_page_"), (page + 1).cast("string"), F.lit("_threshold_"), threshold.cast("string"), F.lit(".png"))


def request_id(at) -> Column:
    return F.concat(F.lit("req_"), F.unix_millis(at).cast("string"))


def readable_start(content, most: int = 10_000) -> Column:
    """The text of a short file in valid UTF-8, else null."""
    return F.when((F.octet_length(content) < most) & F.is_valid_utf8(content.cast("string")), content.cast("string"))


def formats(profile: str = "ui") -> Column:
    """The sorted formats of a service, with dots."""
    return F.array_sort(F.array_distinct(F.array(*(F.lit("." + e) for e in PROFILES[profile].exts))))


def image_like_formats(profile: str = "ui") -> Column:
    own = PROFILES[profile]
    return F.array_sort(F.array_union(F.array(*(F.lit("." + e) for e in own.image_exts)), F.array(*(F.lit("." + e) for e in own.pdf_exts))))
