"""Spark jobs for land-parcel availability data."""
