"""Delivery-performance analytics written as Spark DataFrame jobs."""
