"""Service orders in YAML: compose files and chart values."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

_FIELDS = ["container_name", "image", "tag"]
_KIND = pa.struct([("services", pa.list_(pa.struct([(f, pa.string()) for f in _FIELDS]))), ("error", pa.string())])


def load_yaml(body: str):
    """The mapping of a YAML text, by libyaml where it is there.  PyYAML is needed only where an order is parsed."""
    import yaml

    return yaml.load(body, getattr(yaml, "CSafeLoader", yaml.SafeLoader))


def compose_services(body: str | None) -> list[dict[str, str]]:
    """``services`` of a compose file.

    A missing tag is ``latest``.  An image must split at ``:`` into name and tag at most, so one
    with a registry port is an error, and so is a service without an image.
    """
    listed = (load_yaml(body) or {}).get("services") or {} if body and body.strip() else {}
    out = []
    for name, service in listed.items():
        parts = service["image"].split(":")
        if len(parts) > 2:
            raise ValueError(f"image of service {name!r} has more than one colon: {service['image']!r}")
        out.append({"container_name": name, "image": parts[0], "tag": parts[1] if len(parts) > 1 else "latest"})
    return out


def chart_services(body: str | None) -> list[dict[str, str]]:
    """Top-level entries with an ``image`` that names a repository and a tag; others are skipped."""
    top = load_yaml(body) or {} if body and body.strip() else {}
    out = []
    for name, entry in top.items():
        image = entry.get("image") if isinstance(entry, dict) else None
        if isinstance(image, dict) and image.get("repository") and image.get("tag"):
            out.append({"container_name": name, "image": str(image["repository"]), "tag": str(image["tag"])})
        elif isinstance(image, str) and image.count(":") == 1 and image.split(":")[1]:
            repository, tag = image.split(":")
            out.append({"container_name": name, "image": repository, "tag": tag})
    return out


PARSERS = {"compose": compose_services, "chart": chart_services}


def parse_services(kind: str):
    """A column function from YAML texts to (services, error).

    ``services`` is an array of (container_name, image, tag).  A text that is no such order has null
    services and says why in ``error``; the texts beside it are parsed all the same.
    """
    if kind not in PARSERS:
        raise NotImplementedError(f"no order format named {kind!r}; there are {sorted(PARSERS)}")
    parse = PARSERS[kind]

    def parsed(body: str | None) -> dict:
        try:
            return {"services": [{f: str(s[f]) for f in _FIELDS} for s in parse(body)], "error": None}
        except Exception as e:  # noqa: BLE001  a request may be wrong in any way
            return {"services": None, "error": f"{type(e).__name__}: {e}"[:1000]}

    @F.arrow_udf("struct<services: array<struct<container_name:string,image:string,tag:string>>, error: string>")
    def services(bodies: pa.Array) -> pa.Array:
        return pa.array([parsed(b) for b in bodies.to_pylist()], _KIND)

    return services
