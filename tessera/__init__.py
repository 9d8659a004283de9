"""Tessera: analytics and corpus-preparation operators written as Spark jobs."""
