"""Readers and writers for the file formats the jobs start from and end in."""
