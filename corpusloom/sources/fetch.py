"""Downloads: resumable files and object images.  They need a network; transports are parameters."""

from __future__ import annotations

import io
import json
import os
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Image fields of an object's record, best first.
IMAGE_FIELDS = ("primaryImageSmall", "primaryImage")
#: Images that a task holds at once.
FRAME = 32


def download(url: str, dest: str, *, force: bool = False, chunk: int = 1 << 20, progress: Callable[[int, int | None], None] | None = None, open_=urllib.request.urlopen) -> str:
    """Fetches a file; a partial one is continued, a complete one (or one of unknown size) is left alone."""
    request = urllib.request.Request(url, method="HEAD")
    with open_(request) as answer:
        size = int(answer.headers.get("Content-Length") or 0) or None
    have = os.path.getsize(dest) if os.path.exists(dest) and not force else 0
    if have and (size is None or have == size):
        return dest
    headers = {"Range": f"bytes={have}-"} if have else {}
    os.makedirs(os.path.dirname(dest) or ".", exist_ok=True)
    with open_(urllib.request.Request(url, headers=headers)) as answer:
        resumed = have and answer.status == 206
        done = have if resumed else 0
        with open(dest, "ab" if resumed else "wb") as out:
            while block := answer.read(chunk):
                out.write(block)
                done += len(block)
                if progress:
                    progress(done, size)
    return dest


def image_url(record: dict) -> str | None:
    return next((record[f] for f in IMAGE_FIELDS if record.get(f)), None)


def centre_square(width: int, height: int) -> tuple[int, int, int, int]:
    """The largest square in the middle of an image, as left, top, right, bottom."""
    side = min(width, height)
    left, top = (width - side) // 2, (height - side) // 2
    return left, top, left + side, top + side


def prepare_image(raw: bytes, size: int = 224) -> bytes:
    """A JPEG of the image's centre square in RGB, ``size`` pixels wide; needs Pillow where the tasks run."""
    from PIL import Image

    with Image.open(io.BytesIO(raw)) as image:
        rgb = image.convert("RGB")
    out = io.BytesIO()
    rgb.crop(centre_square(*rgb.size)).resize((size, size), Image.LANCZOS).save(out, "JPEG", quality=90)
    return out.getvalue()


def fetch_images(ids: DataFrame, get: Callable[[str], bytes], api: str, *, workers: int = 8, transform: Callable[[bytes], bytes] = bytes) -> DataFrame:
    """(id, status, detail, content) for a DataFrame of ids: record, image, ``transform`` (crop and resize).

    ``status`` is ok, no_image or error; append it to the journal, and the
    contents to the image store, in one streaming batch or job.
    """

    def entry(id_: str) -> tuple:
        try:
            url = image_url(json.loads(get(f"{api}/{id_}")))
            return (id_, "ok", "", transform(get(url))) if url else (id_, "no_image", "", None)
        except Exception as e:  # one object's failure is an entry, not the job's
            return id_, "error", str(e), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), FRAME):
                yield pd.DataFrame(map(entry, batch["id"].iloc[k : k + FRAME]), columns=["id", "status", "detail", "content"])

    return ids.select("id").repartition(workers).mapInPandas(run, "id string, status string, detail string, content binary")
