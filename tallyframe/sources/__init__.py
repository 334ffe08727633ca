"""Readers and writers: CSV datasets, questions, answers, responses, reports."""
