"""Readers of projects, JSON folders and settings."""
