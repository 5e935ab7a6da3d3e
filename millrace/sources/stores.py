"""Stores of objects as executors see them: their keys in order, and content by key.

What runs in workers is made by functions inside functions, so that it travels with its code to
workers that lack this package.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.sql import SparkSession

# Which of pyarrow's schemes serves a scheme of Hadoop's.
SCHEMES = {
    "file": "file",
    "s3": "s3",
    "s3a": "s3",
    "s3n": "s3",
    "wasb": "abfs",
    "wasbs": "abfss",
    "abfs": "abfs",
    "abfss": "abfss",
    "gs": "gs",
    "hdfs": "hdfs",
}
# The settings of Hadoop's client for S3, by the name they get here.
S3_SETTINGS = {
    "access_key": "access.key",
    "secret_key": "secret.key",
    "session_token": "session.token",
    "region": "endpoint.region",
    "endpoint": "endpoint",
    "path_style": "path.style.access",
    "ssl": "connection.ssl.enabled",
    "provider": "aws.credentials.provider",
}


def place_of(root: str, setting: Callable[[str], str | None]) -> dict | None:
    """Where a qualified root is, for :func:`opener`; null if no file system here serves it.

    ``setting`` gives the session's Hadoop settings. Those of a bucket come before the others.
    """
    scheme, rest = root.split(":", 1)
    if scheme not in SCHEMES:
        return None
    place = {"scheme": SCHEMES[scheme], "rest": rest}
    if place["scheme"] == "file":
        return place | {"base": "/" + rest.strip("/")}
    parts = urlsplit(f"x:{rest}")
    if place["scheme"] == "s3":
        bucket = parts.netloc
        place |= {"bucket": bucket, "base": f"{bucket}{parts.path}".rstrip("/")}
        for name, key in S3_SETTINGS.items():
            value = setting(f"fs.s3a.bucket.{bucket}.{key}") or setting(f"fs.s3a.{key}")
            if value:
                place[name] = value
        return place
    # Blob and file system endpoints of one account differ in their host only.
    place["rest"] = rest.replace(".blob.core.", ".dfs.core.") if scheme in ("wasb", "wasbs") else rest
    return place


def session_place(spark: SparkSession, root: str) -> dict | None:
    """``place_of`` a root as the session's file systems complete it.

    A scheme that the session has no Java classes for is taken as it is written.
    """
    hadoop = spark._jsc.hadoopConfiguration()
    scheme = root.split("://", 1)[0] if "://" in root else None
    if scheme in SCHEMES and scheme != "file":
        return place_of(root.rstrip("/"), hadoop.get)
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    qualified = path.getFileSystem(hadoop).makeQualified(path).toString().rstrip("/")
    return place_of(qualified, hadoop.get)


def signer() -> Callable:
    """A function that signs a request to an S3 service (version 4 of its signatures)."""

    def sign(
        method: str, host: str, path: str, query: dict, when, region: str, access: str, secret: str,
        token: str | None = None,
    ) -> tuple[str, dict[str, str]]:
        """The query string and the headers of a request without a body."""
        import hashlib
        import hmac
        from urllib.parse import quote

        empty = hashlib.sha256(b"").hexdigest()
        stamp, day = when.strftime("%Y%m%dT%H%M%SZ"), when.strftime("%Y%m%d")
        headers = {"host": host, "x-amz-content-sha256": empty, "x-amz-date": stamp}
        if token:
            headers["x-amz-security-token"] = token
        line = "&".join(
            f"{quote(k, safe='-_.~')}={quote(v, safe='-_.~')}" for k, v in sorted(query.items())
        )
        names = ";".join(sorted(headers))
        request = "\n".join(
            [method, path, line, *(f"{k}:{headers[k]}" for k in sorted(headers)), "", names, empty]
        )
        scope = f"{day}/{region}/s3/aws4_request"
        text = "\n".join(
            ["AWS4-HMAC-SHA256", stamp, scope, hashlib.sha256(request.encode()).hexdigest()]
        )
        key = f"AWS4{secret}".encode()
        for part in (day, region, "s3", "aws4_request"):
            key = hmac.new(key, part.encode(), hashlib.sha256).digest()
        signature = hmac.new(key, text.encode(), hashlib.sha256).hexdigest()
        headers["Authorization"] = (
            f"AWS4-HMAC-SHA256 Credential={access}/{scope},SignedHeaders={names},Signature={signature}"
        )
        return line, headers

    return sign


def opener(place: dict, send: Callable | None = None) -> Callable:
    """A function that opens the store at ``place``, to be called in a worker or the driver.

    A store has ``entries(after, until)``, the objects with a key beyond ``after`` and not beyond
    ``until`` in the order of their keys as (key, length, modified); ``cuts(parts, after, until)``,
    keys that cut such a range into about equal parts, and whether it has few objects;
    ``info(key)``, the length and time of an object, or null; and ``open(key)``. ``send`` takes the
    place of HTTP requests to S3: from a URL and headers it gives a status and a body.
    """
    sign = signer()
    environment = {name: os.environ.get(name) for name in ("AWS_REGION", "AWS_DEFAULT_REGION")}

    def file_system():
        """The file system of pyarrow and the root's path in it."""
        from urllib.parse import quote

        from pyarrow import fs

        if place["scheme"] == "s3":
            endpoint = place.get("endpoint")
            scheme = "https" if place.get("ssl", "true") == "true" else "http"
            if endpoint and "://" in endpoint:
                scheme, endpoint = endpoint.split("://", 1)
            options = {
                "access_key": place.get("access_key"),
                "secret_key": place.get("secret_key"),
                "session_token": place.get("session_token"),
                "anonymous": "Anonymous" in place.get("provider", ""),
                "region": place.get("region"),
                "endpoint_override": endpoint,
                "scheme": scheme,
            }
            return fs.S3FileSystem(**{k: v for k, v in options.items() if v}), place["base"]
        store, path = fs.FileSystem.from_uri(f"{place['scheme']}:{quote(place['rest'], safe='/@:')}")
        return store, path.rstrip("/")

    #: Entries that are looked at to cut a range; with no more the range has few objects.
    few = 10_000

    class Folders:
        """A store that lists folder by folder."""

        def scan(self, folder: str) -> list[tuple[str, bool, object]]:
            raise NotImplementedError

        def measured(self, key: str, entry) -> tuple[int, object] | None:
            raise NotImplementedError

        def _items(self, folder: str, after: str, until: str | None):
            """What is in a folder and may hold keys of the range: (key, is a folder, entry)."""
            for name, is_folder, entry in self.scan(folder):
                key = folder + name
                if until is not None and key > until:
                    return
                # All keys in a folder are less than its name with the sign after the slash.
                if (key[:-1] + "0" if is_folder else key) > after:
                    yield key, is_folder, entry

        def entries(self, after: str = "", until: str | None = None, folder: str = ""):
            for key, is_folder, entry in self._items(folder, after, until):
                if is_folder:
                    yield from self.entries(after, until, key)
                elif (measured := self.measured(key, entry)) is not None:
                    yield key, *measured

        def cuts(self, parts: int, after: str = "", until: str | None = None):
            items = [(key, is_folder) for key, is_folder, _ in self._items("", after, until)]
            while len(items) < few and any(is_folder for _, is_folder in items):
                wider = []
                for n, (key, is_folder) in enumerate(items):
                    if is_folder and len(wider) + len(items) - n < few:
                        wider += [(k, f) for k, f, _ in self._items(key, after, until)]
                    else:
                        wider.append((key, is_folder))
                if wider == items:
                    break
                items = wider
            complete = len(items) <= few and not any(is_folder for _, is_folder in items)
            step = max(1, -(-len(items) // parts))
            ends = items[step - 1 : -1 : step]
            return [key[:-1] + "0" if is_folder else key for key, is_folder in ends], complete

    class LocalFiles(Folders):
        """Files of a file system that all workers have. Links to folders are not followed."""

        def __init__(self):
            import datetime
            import os

            self.os, self.base = os, place["base"].rstrip("/")
            self.time = lambda t: datetime.datetime.fromtimestamp(t, datetime.timezone.utc)

        def scan(self, folder):
            found = []
            with self.os.scandir(f"{self.base}/{folder}") as entries:
                for entry in entries:
                    if entry.is_dir(follow_symlinks=False):
                        found.append((f"{entry.name}/", True, entry))
                    elif entry.is_file():
                        found.append((entry.name, False, entry))
            return sorted(found, key=lambda item: item[0])

        def measured(self, key, entry):
            try:
                stat = entry.stat()
            except FileNotFoundError:  # gone since its folder was read
                return None
            return stat.st_size, self.time(stat.st_mtime)

        def info(self, key):
            import stat

            try:
                found = self.os.stat(f"{self.base}/{key}")
            except (FileNotFoundError, NotADirectoryError):
                return None
            if not stat.S_ISREG(found.st_mode):
                return None
            return found.st_size, self.time(found.st_mtime)

        def open(self, key):
            return open(f"{self.base}/{key}", "rb")

    class ArrowFiles(Folders):
        """Objects of a file system of pyarrow."""

        def __init__(self):
            from pyarrow import fs

            self.fs = fs
            self.store, self.base = file_system()

        def scan(self, folder):
            path = f"{self.base}/{folder}".rstrip("/")
            found = []
            for info in self.store.get_file_info(self.fs.FileSelector(path)):
                name = info.base_name
                if info.type == self.fs.FileType.Directory:
                    found.append((f"{name}/", True, info))
                elif info.is_file:
                    found.append((name, False, info))
            return sorted(found, key=lambda item: item[0])

        def measured(self, key, entry):
            return entry.size, entry.mtime

        def info(self, key):
            found = self.store.get_file_info(f"{self.base}/{key}")
            return (found.size, found.mtime) if found.is_file else None

        def open(self, key):
            return self.store.open_input_file(f"{self.base}/{key}")

    class Pages(ArrowFiles):
        """A bucket whose keys are listed in pages, from any key on, without folders."""

        def __init__(self):
            if send is None:
                super().__init__()
            self.base = place["base"]
            self.prefix = self.base[len(place["bucket"]) + 1 :]
            self.prefix += "/" if self.prefix else ""
            self.region = place.get("region") or next(filter(None, environment.values()), "us-east-1")
            endpoint = place.get("endpoint") or f"s3.{self.region}.amazonaws.com"
            ssl = place.get("ssl", "true") == "true"
            scheme, _, host = endpoint.rpartition("://")
            self.scheme = scheme or ("https" if ssl else "http")
            by_path = place.get("path_style") == "true"
            self.host = host if by_path else f"{place['bucket']}.{host}"
            self.path = f"/{place['bucket']}" if by_path else "/"

        def request(self, query: dict) -> tuple[int, bytes]:
            import datetime
            import urllib.error
            import urllib.request

            now = datetime.datetime.now(datetime.timezone.utc)
            keys = (place["access_key"], place["secret_key"], place.get("session_token"))
            line, headers = sign("GET", self.host, self.path, query, now, self.region, *keys)
            url = f"{self.scheme}://{self.host}{self.path}?{line}"
            if send is not None:
                return send(url, headers)
            try:
                with urllib.request.urlopen(urllib.request.Request(url, headers=headers)) as answer:
                    return answer.status, answer.read()
            except urllib.error.HTTPError as error:
                return error.code, error.read()

        def page(self, after: str, most: int = 1000) -> tuple[list[tuple], bool]:
            """The next objects beyond a key, and whether there are more."""
            import datetime
            from urllib.parse import unquote
            from xml.etree import ElementTree

            query = {"list-type": "2", "max-keys": str(most), "encoding-type": "url"}
            if self.prefix:
                query["prefix"] = self.prefix
            if self.prefix or after:
                query["start-after"] = self.prefix + after
            status, body = self.request(query)
            if status in (401, 403):
                raise PermissionError(f"ACCESS_DENIED: {place['bucket']}")
            if status == 404:
                raise FileNotFoundError(f"PATH_NOT_FOUND: {place['bucket']}")
            if status != 200:
                raise OSError(f"Listing {place['bucket']} failed with {status}: {body[:200]!r}")
            top = ElementTree.fromstring(body)
            space = top.tag[: top.tag.index("}") + 1] if "}" in top.tag else ""
            found = []
            for entry in top.iter(f"{space}Contents"):
                key = unquote(entry.findtext(f"{space}Key"))[len(self.prefix) :]
                when = entry.findtext(f"{space}LastModified").replace("Z", "+00:00")
                size = int(entry.findtext(f"{space}Size"))
                found.append((key, size, datetime.datetime.fromisoformat(when)))
            return found, top.findtext(f"{space}IsTruncated") == "true"

        def entries(self, after: str = "", until: str | None = None):
            more = True
            while more:
                found, more = self.page(after)
                for key, size, modified in found:
                    if until is not None and key > until:
                        return
                    after = key
                    # The mark of a folder is an object without content whose key ends in a slash.
                    if key and not key.endswith("/"):
                        yield key, size, modified

        def cuts(self, parts: int, after: str = "", until: str | None = None):
            found, more = self.page(after)
            inside = [key for key, *_ in found if until is None or key <= until]
            if not more or len(inside) < len(found):
                step = max(1, -(-len(inside) // parts))
                return inside[step - 1 : -1 : step], True
            # From sign to sign: the first key with each next sign after a common beginning.
            beginnings, cuts, asked = [""], [], 0
            while beginnings and len(cuts) < parts and asked < 4 * parts + 1024:
                wider = []
                for beginning in beginnings:
                    last = max(after, beginning)
                    while asked < 4 * parts + 1024:
                        asked += 1
                        found, _ = self.page(last, 1)
                        key = found[0][0] if found else None
                        if (
                            key is None
                            or not key.startswith(beginning)
                            or (until is not None and key > until)
                        ):
                            break
                        wider.append(key[: len(beginning) + 1])
                        last = wider[-1] + "\U0010ffff"
                beginnings = wider
                cuts = sorted({*cuts, *(b for b in wider if b > after)})
            return cuts, False

    def open_store():
        if place["scheme"] == "file":
            return LocalFiles()
        if place["scheme"] == "s3" and "access_key" in place:
            return Pages()
        return ArrowFiles()

    return open_store
