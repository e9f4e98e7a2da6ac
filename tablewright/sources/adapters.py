"""Readers by optional libraries, for those who have them: pdfplumber (pages and text tables), PyMuPDF (pictures of pages)
and pytesseract (orientation). Each imports its library where it runs, on the executors."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator


def pdf_pages(content: bytes) -> Iterator[tuple[int, str, int]]:
    """(page number from 1, text, number of pictures) of each page."""
    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for n, page in enumerate(pdf.pages, 1):
            yield n, page.extract_text() or "", len(page.images)


def pdf_tables(content: bytes, settings: dict) -> Iterator[tuple[int, int, list[list[str | None]] | Exception]]:
    """(page, table number from 1, rows) by the given settings; a table that fails is its exception."""
    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for n, page in enumerate(pdf.pages, 1):
            for t, found in enumerate(page.find_tables(settings), 1):
                try:
                    yield n, t, found.extract()
                except Exception as e:  # this table's alone
                    yield n, t, e


def pdf_pictures(content: bytes, zoom: int) -> Iterator[tuple[int, bytes | None]]:
    """(page, PNG bytes) of each page at zoom; None for a page that can't be rendered."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        for n in range(len(doc)):
            try:
                yield n + 1, doc[n].get_pixmap(matrix=fitz.Matrix(zoom, zoom)).tobytes("png")
            except Exception:
                yield n + 1, None


def turn_by_text(data: bytes) -> int:
    """Degrees to turn a picture counter-clockwise, by an orientation report; 0 where there is none."""
    import pytesseract
    from PIL import Image

    from .pages import orientation_of

    try:
        return orientation_of(pytesseract.image_to_osd(Image.open(io.BytesIO(data))))
    except Exception:
        return 0


#: What a model is asked about a picture of a page.
PROMPT = """The picture shows a page of a document with at most one table of interest. Return that table as CSV and nothing else.

- The first line names the columns. Begin with the columns Row_Type and Category, then one column for each period or
  amount as printed, and last a column Notes if rows have notes.
- Row_Type is HEADER for a heading or a remark without amounts, DETAIL for a single item, ROLLUP for a sum of the items
  above it or below it.
- Copy amounts as they are printed, with their commas, percent signs and parentheses, and quote fields that hold commas.
- Keep the order of the rows, leave empty cells empty, and invent nothing. Without a table return an empty answer."""
MAX_TOKENS = 4096


def by_model(ask: Callable[[str, bytes, int], str], prompt: str = PROMPT, max_tokens: int = MAX_TOKENS) -> Callable[[bytes, int], str]:
    """A page extractor from a function that sends (prompt, PNG bytes, most tokens) to a model and returns its answer."""

    def extract(image: bytes, page: int) -> str:
        return ask(prompt, image, max_tokens)

    return extract
