"""Declared schemas of the input tables; nothing is inferred."""

from docfields.functions.geometry import PAGES

# One row per photo. `page_w` and `page_h` are the photo's size (0 or NULL: unknown), `pages` is the OCR annotation tree as the OCR service returns it.
CAPTURES = (
    "submission_id bigint, kind string, side string, captured_at timestamp_ntz, "
    f"full_text string, page_w int, page_h int, pages {PAGES}"
)
# where readers of text formats leave a row that they cannot parse
CORRUPT = "_corrupt_record"
FACES = "submission_id bigint, face_id int, x0 int, y0 int, x1 int, y1 int"
