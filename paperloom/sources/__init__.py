"""Readers and writers: saved collections, records of scholarly services, HTML listings, homepages, result artifacts."""
