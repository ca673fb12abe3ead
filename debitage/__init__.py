"""Spark jobs over corpora of annotated triangle meshes."""
