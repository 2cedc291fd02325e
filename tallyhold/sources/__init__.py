"""Readers: zipped filings, landed JSON documents, price bars, and the warehouse adapter."""
