"""Readers of tables, trees and lock files, and text extractors."""
