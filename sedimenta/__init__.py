"""A content-aware catalogue, packing and similarity engine written for Spark."""
