"""Exports of records: distributed rows, and single files written from them in a stream."""
