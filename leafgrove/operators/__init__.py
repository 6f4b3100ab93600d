"""Operators on texts, trees and units."""
