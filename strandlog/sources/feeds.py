"""Byte feeds: files, standard input and HTTP(S), read in bounded chunks on the reader's side."""

from __future__ import annotations

import ipaddress
import os
import re
import socket
import sys
import urllib.error
import urllib.request
from collections.abc import Iterator
from http.client import HTTPConnection, HTTPSConnection
from typing import BinaryIO

from ..errors import EngineError, require
from ..functions.scalars import PRIVATE_NAMES, PRIVATE_PREFIXES, UNROUTABLE, ipv4_number

CONNECT_SECONDS = 15


def private_host(uri: str) -> bool:
    """The lexical rule of functions.scalars.private_host, for one URI."""
    _, mark, rest = uri.partition("://")
    if not mark:
        return False
    authority = re.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2]
    if authority.startswith("["):
        host = authority[: authority.index("]") + 1] if "]" in authority else authority
    else:
        host = authority.partition(":")[0]
    host = host.lower()
    if host in PRIVATE_NAMES or host.endswith(".localhost") or host.startswith(tuple(PRIVATE_PREFIXES)):
        return True
    found = re.match(r"172\.([^.]*)\.", host)
    if not found:
        return False
    number = re.match(r"\s*([+-]?\d+)", found[1])
    return not number or not -(1 << 31) <= int(number[1]) < 1 << 31 or 16 <= int(number[1]) <= 31


def routable(address: str) -> bool:
    """Whether a connection to a resolved address is allowed."""
    ip = ipaddress.ip_address(address)
    if ip.version == 6 and ip.ipv4_mapped:
        ip = ip.ipv4_mapped
    if ip.version == 4:
        return not any(int(ip) >> 32 - bits == ipv4_number(network) >> 32 - bits for network, bits in UNROUTABLE)
    return ip in ipaddress.ip_network("2000::/3") and ip not in ipaddress.ip_network("2001:db8::/32")


def _checked(connection: type):
    class Checked(connection):
        def connect(self) -> None:
            for *_, address in socket.getaddrinfo(self.host, self.port, type=socket.SOCK_STREAM):
                if not routable(address[0]):
                    raise EngineError("unauthorized_source", "the host resolves to an address that is not public")
            self._create_connection = lambda pair, *a, **b: self._dial(pair)
            super().connect()

        def _dial(self, pair) -> socket.socket:
            s = socket.create_connection(pair, CONNECT_SECONDS)
            if not routable(s.getpeername()[0]):
                s.close()
                raise EngineError("unauthorized_source", "the host resolves to an address that is not public")
            s.settimeout(None)
            return s

    return Checked


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


def _open_http(uri: str, deny_private: bool) -> BinaryIO:
    handlers: list = [_NoRedirect()]
    if deny_private:
        http, https = _checked(HTTPConnection), _checked(HTTPSConnection)

        class Http(urllib.request.HTTPHandler):
            def http_open(self, request):
                return self.do_open(http, request)

        class Https(urllib.request.HTTPSHandler):
            def https_open(self, request):
                return self.do_open(https, request, context=self._context)

        handlers += [Http(), Https(), urllib.request.ProxyHandler({})]
    try:
        answer = urllib.request.build_opener(*handlers).open(uri)
    except urllib.error.HTTPError as e:
        raise EngineError("network" if e.code >= 400 else "protocol", f"HTTP status {e.code}", e.code >= 400) from e
    except (urllib.error.URLError, OSError) as e:
        raise EngineError("network", f"cannot fetch: {e}", True) from e
    if not 200 <= answer.status < 300:
        raise EngineError("protocol", f"HTTP status {answer.status}")
    return answer


class Prepared:
    """A source that is open before anything is written."""

    def __init__(self, uri: str, maximum_bytes: int, deny_private: bool = True):
        require(bool(uri) and maximum_bytes > 0, "invalid_argument", "capture needs a source and a limit")
        self.uri, self.maximum, self.deny, self.file = uri, maximum_bytes, deny_private, None
        if uri.startswith(("http://", "https://")):
            require(not (deny_private and private_host(uri)), "unauthorized_source", "the host is private")
            return
        if uri == "-":
            self.file = os.fdopen(os.dup(sys.stdin.fileno()), "rb", 0)
            return
        path = uri.removeprefix("file://")
        require("://" not in path, "protocol", "unsupported source scheme")
        try:
            self.file = os.fdopen(os.open(path, os.O_RDONLY | os.O_NOFOLLOW), "rb", 0)
        except OSError as e:
            raise EngineError("archive_io", f"cannot open source: {e.strerror}") from e

    def chunks(self, size: int) -> Iterator[bytes]:
        """Each read is a chunk; one that would pass the limit is not given."""
        source = self.file or _open_http(self.uri, self.deny)
        total = 0
        with source:
            while True:
                try:
                    data = source.read(size)
                except OSError as e:
                    raise EngineError("archive_io", f"cannot read source: {e}") from e
                if not data:
                    return
                total += len(data)
                require(total <= self.maximum, "resource_exhausted", "the feed is over its limit")
                yield data
