"""Payload scans, durable files, leases, the on-disk store and its generations."""
