"""Files from elsewhere into a raw folder, once: checksums, retries, whole files only.

This runs before the engine, on one machine; the engine reads the raw folder.  What opens an
address and what sleeps are parameters, so that tests need no network.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

# Answers worth another try, and seconds between tries.
AGAIN = {408, 425, 429, 500, 502, 503, 504}
FIRST_WAIT, LONGEST_WAIT, CHUNK = 4, 120, 1 << 20


class FetchError(RuntimeError):
    pass


def opened(address: str, timeout: float = 60) -> tuple[int, dict, Iterator[bytes]]:
    """Status, headers and body of an address."""
    try:
        r = urllib.request.urlopen(address, timeout=timeout)
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers or {}), iter(())
    return r.status, dict(r.headers), iter(lambda: r.read(CHUNK), b"")


def digest_of(path: Path) -> str:
    h = hashlib.sha256()
    with path.open("rb") as f:
        while part := f.read(CHUNK):
            h.update(part)
    return h.hexdigest()


def download(address: str, path: Path, tries: int = 5, open_: Callable = opened, sleep: Callable = time.sleep) -> str:
    """Writes a file under another name, renames it when it is whole, and returns its digest."""
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    for k in range(tries):
        status, headers, body = open_(address)
        if status == 200:
            h = hashlib.sha256()
            with part.open("wb") as f:
                for data in body:
                    h.update(data)
                    f.write(data)
            if part.stat().st_size:
                os.replace(part, path)
                return h.hexdigest()
        elif status not in AGAIN and status != 202:
            raise FetchError(f"{address}: status {status}")
        if k + 1 < tries:
            wait = headers.get("Retry-After", "")
            sleep(min(LONGEST_WAIT, int(wait) if wait.isdigit() else FIRST_WAIT * 2**k))
    raise FetchError(f"{address}: no answer after {tries} tries")


def read_manifest(folder: Path) -> dict:
    path = folder / "manifest.json"
    return json.loads(path.read_text()) if path.exists() else {}


def record(folder: Path, key: str, entry: dict) -> None:
    """Adds or replaces an entry; keys stay sorted."""
    entries = read_manifest(folder) | {key: entry}
    part = folder / "manifest.json.part"
    part.write_text(json.dumps(dict(sorted(entries.items())), indent=1, sort_keys=True))
    os.replace(part, folder / "manifest.json")


def fetch(address: str, folder: str | Path, key: str, licence: str, note: str = "", expected: str | None = None, refresh: bool = False, **options) -> Path:
    """The file of an address. A file in the folder is trusted only if its digest is the
    manifest's; else it is fetched again."""
    folder = Path(folder)
    path, entry = folder / key, read_manifest(folder).get(key)
    if not refresh and entry and path.exists() and digest_of(path) == entry["sha256"] and expected in (None, entry["sha256"]):
        return path
    got = download(address, path, **options)
    if expected and got != expected:
        path.unlink()
        raise FetchError(f"{address}: digest {got} is not {expected}")
    record(folder, key, {"url": address, "sha256": got, "bytes": path.stat().st_size, "downloaded": datetime.date.today().isoformat(), "licence": licence, "note": note})
    return path


def only_member(names: list[str], part: str) -> str:
    """The one name that holds a part."""
    found = [n for n in names if part in n]
    if len(found) != 1:
        raise FetchError(f"{len(found)} members hold {part!r}")
    return found[0]


def fetch_all(wanted: dict[str, str], folder: str | Path, licence: str, at_once: int = 4, **options) -> dict[str, Path]:
    """Files of several addresses (key: address), some at once; the first error is raised when all
    have ended."""
    with ThreadPoolExecutor(at_once) as pool:
        # Downloads run side by side; entries are recorded one after the other.
        folder = Path(folder)
        known = read_manifest(folder)
        missing = {k: a for k, a in wanted.items() if not (k in known and (folder / k).exists() and digest_of(folder / k) == known[k]["sha256"])}
        running = {k: pool.submit(download, a, folder / k, **options) for k, a in missing.items()}
    for k, r in running.items():
        record(folder, k, {"url": wanted[k], "sha256": r.result(), "bytes": (folder / k).stat().st_size, "downloaded": datetime.date.today().isoformat(), "licence": licence, "note": ""})
    return {k: folder / k for k in wanted}


def network_first(address: str, folder: str | Path, key: str, licence: str = "", **options) -> tuple[Path, bool]:
    """The file of an address, fresh if the network gives it, and else the one that is kept; also
    whether it is fresh."""
    try:
        return fetch(address, folder, key, licence, refresh=True, **options), True
    except (FetchError, OSError):
        if (Path(folder) / key).exists():
            return Path(folder) / key, False
        raise


def ask(body: str, endpoints: list[str], folder: str | Path, key: str, licence: str, refresh: bool = False, tries: int = 6, open_: Callable = opened, sleep: Callable = time.sleep) -> Path:
    """The answer to a query, from whichever of some endpoints gives one: each try goes to the next.
    An answer is kept under the query's digest, so another query is another file."""
    folder = Path(folder)
    name = f"{key}-{hashlib.sha256(body.encode()).hexdigest()[:16]}.json"
    entry = read_manifest(folder).get(name)
    if not refresh and entry and (folder / name).exists() and digest_of(folder / name) == entry["sha256"]:
        return folder / name
    last: Exception | None = None
    for k in range(tries):
        address = f"{endpoints[k % len(endpoints)]}?{urllib.parse.urlencode({'data': body})}"
        try:
            return fetch(address, folder, name, licence, refresh=True, tries=1, open_=open_, sleep=sleep)
        except FetchError as e:
            last = e
            if k + 1 < tries:
                # A wait after every round of all endpoints.
                sleep(min(LONGEST_WAIT, FIRST_WAIT * 2 ** (k // len(endpoints))) if (k + 1) % len(endpoints) == 0 else 0)
    raise FetchError(f"no endpoint answered: {last}")
