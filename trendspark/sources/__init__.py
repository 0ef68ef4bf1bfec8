"""Readers: feed XML, landed JSON answers, images, literal dimensions."""
