"""Schemas and closed value sets of the ledger: a property multigraph with provenance."""

from __future__ import annotations

# Fixed values of the ledger format.
VERSION = "v2"
NODE_KINDS = ("svc", "ref", "topic", "queue", "db", "cache", "store", "ext")
RELATIONS = ("pub", "sub", "http", "grpc", "gql", "ws", "uses", "dep")
TAGS = ("CODE", "INFERENCE", "UNVERIFIED")
SEVERITIES = ("high", "med", "low", "info")
CHANNELS = ("topic", "queue")
STORES = ("db", "cache", "store")
SYNC = ("http", "grpc", "gql", "ws")
BLOCK_ORDERS = ("", "N", "NE", "NEG", "NG", "E", "EG", "G")
NO_LABEL = "-"

RECEIPTS = "array<struct<path:string,lines:array<int>>>"
NODES = f"id string, kind string, tech string, receipts {RECEIPTS}"
EDGES = f"actor string, rel string, object string, label string, tag string, receipts {RECEIPTS}, note string"
GAPS = f"subject string, detail string, receipts {RECEIPTS}"
SIGHTINGS = "actor string, rel string, object string, label string, tag string, path string, line int, note string"
EDGE_KEY = ["actor", "rel", "object", "label"]


class AmbiguousSubject(ValueError):
    """A question names something that several nodes, or none, could be."""
