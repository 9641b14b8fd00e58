"""Readers and writers of sequencing files, local or on any Hadoop file system."""
